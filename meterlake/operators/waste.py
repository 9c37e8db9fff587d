"""Waste rules over priced usage entries, each with at most one finding.

Rules over rows are conditional sums, all taken in one pass over the entries; rules over sessions are plans of
their own, a session's thirds coming from its row numbers.  Money is summed in whole billionths of a dollar.
Findings are united, and the headline is capped by what was spent.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.operators.reports import usd
from meterlake.plans.ratecard import CARD, cost, nano, priced, prompt_tokens

SEVERITY = {"high": 3, "medium": 2, "low": 1}
#: The cheaper model of a flagship's family.
DOWNGRADES = [("claude-opus", "claude-haiku-4-5"), ("gpt-5.5", "gpt-5.4-mini")]


class RowRule(NamedTuple):
    """Rows that count, dollars that each wastes, and what their sums must be: ``keep`` gets the columns n,
    prompt, read and written (tokens of the rows that count)."""

    name: str
    severity: str
    where: Column
    waste: Column
    keep: Callable[[Column, Column, Column, Column], Column]


def _dearer(a: str, b: str) -> Column:
    return F.greatest(F.col(a) - F.col(b), F.lit(0.0)) / 1e6


def cache_starvation(min_prompt=5_000, min_sample=20, min_rate=0.10) -> RowRule:
    return RowRule(
        "cache-hit-starvation", "medium", prompt_tokens() > min_prompt, F.col("input_tokens") * _dearer("rate_in", "rate_cr"),
        lambda n, prompt, read, written: (n >= min_sample) & (read / prompt < min_rate),
    )


def dead_zone(min_sample=20, min_written=20_000, max_ratio=0.05) -> RowRule:
    """Caches written at a premium and hardly read."""
    return RowRule(
        "cache-dead-zone", "medium", F.col("cache_creation_tokens") > 0, F.col("cache_creation_tokens") * _dearer("rate_cw", "rate_in"),
        lambda n, prompt, read, written: (n >= min_sample) & (written >= min_written) & (read / written <= max_ratio),
    )


def flagship_trivial(max_prompt=2_000, max_output=600, min_sample=10) -> RowRule:
    rates = {k: r for k, *r in CARD}
    cheap = [F.lit(None).cast("double")] * 4
    for prefix, to in reversed(DOWNGRADES):
        cheap = [F.when(F.startswith(F.lower("model"), F.lit(prefix)), F.lit(r)).otherwise(c) for r, c in zip(rates[to], cheap, strict=True)]
    tokens = ["input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens"]
    delta = cost() - sum((F.col(t) * c for t, c in zip(tokens, cheap, strict=True)), F.lit(0.0)) / 1e6
    where = (prompt_tokens() <= max_prompt) & (F.col("output_tokens") <= max_output) & (delta > 0)
    return RowRule("model-overreliance", "medium", where, delta, lambda n, *_: n >= min_sample)


def reasoning_overuse(min_reasoning=1_000, max_prompt=2_000, min_sample=10) -> RowRule:
    spent = F.col("reasoning_tokens") * F.col("rate_out") / 1e6
    where = (F.col("reasoning_tokens") >= min_reasoning) & (prompt_tokens() <= max_prompt) & (spent > 0)
    return RowRule("reasoning-effort-overuse", "medium", where, spent, lambda n, *_: n >= min_sample)


def context_saturation(min_fill=0.85, min_sample=10) -> RowRule:
    where = (F.col("context_window") > 0) & (prompt_tokens() / F.when(F.col("context_window") > 0, F.col("context_window")) >= min_fill)
    return RowRule("context-window-saturation", "low", where, F.col("input_tokens") * F.col("rate_in") / 1e6, lambda n, *_: n >= min_sample)


def _sessions(e: DataFrame) -> DataFrame:
    return e.filter("session_id is not null")


def runaway_growth(e: DataFrame, min_turns=8, factor=3.0) -> DataFrame:
    by = Window.partitionBy("session_id")
    s = _sessions(e).withColumn("k", F.row_number().over(by.orderBy("ts", "id"))).withColumn("turns", F.count("*").over(by)).filter(F.col("turns") >= min_turns)
    third = F.greatest(F.floor(F.col("turns") / 3), F.lit(1))
    early, late = F.col("k") <= third, F.col("k") > F.col("turns") - third
    s = s.withColumn("e", F.avg(F.when(early, prompt_tokens())).over(by)).withColumn("l", F.avg(F.when(late, prompt_tokens())).over(by)).withColumn("base", F.avg(F.when(early, F.col("input_tokens"))).over(by))
    grown = s.filter((F.col("e") > 0) & (F.col("l") >= factor * F.col("e")))
    over = nano(F.greatest(F.col("input_tokens") - F.col("base"), F.lit(0.0)) * F.col("rate_in") / 1e6)
    each = grown.groupBy("session_id").agg(F.sum(over).alias("w")).filter("w > 0")
    a = each.agg(F.count("*").alias("n"), F.sum("w").alias("waste")).filter("waste > 0")
    return a.select(F.lit("runaway-context-growth").alias("rule"), F.lit("low").alias("severity"), "n", "waste")


def mega_sessions(e: DataFrame, min_turns=40, min_prompt=500_000) -> DataFrame:
    """Reported without dollars."""
    s = _sessions(e).groupBy("session_id").agg(F.count("*").alias("t"), F.sum(prompt_tokens()).alias("p")).filter((F.col("t") >= min_turns) & (F.col("p") >= min_prompt))
    a = s.agg(F.count("*").alias("n")).filter("n > 0")
    return a.select(F.lit("mega-sessions").alias("rule"), F.lit("low").alias("severity"), "n", F.lit(0).cast("long").alias("waste"))


#: Both kinds may be extended by the caller: plans take priced entries and return (rule, severity, n, waste).
ROW_RULES: list[Callable[[], RowRule]] = [cache_starvation, dead_zone, flagship_trivial, reasoning_overuse, context_saturation]
PLANS: list[Callable[[DataFrame], DataFrame]] = [runaway_growth, mega_sessions]


def _found(e: DataFrame, row_rules, plans) -> DataFrame:
    """(rule, severity, n, waste in billionths)."""
    rules = [make() for make in row_rules]
    sums = {"prompt": prompt_tokens(), "read": F.col("cache_read_tokens"), "written": F.col("cache_creation_tokens")}
    aggs = []
    for i, r in enumerate(rules):
        aggs += [F.count_if(r.where).alias(f"n{i}"), F.coalesce(F.sum(F.when(r.where, nano(r.waste))), F.lit(0)).alias(f"waste{i}")]
        aggs += [F.sum(F.when(r.where, x)).alias(f"{k}{i}") for k, x in sums.items()]
    parts = []
    if rules:
        each = []
        for i, r in enumerate(rules):
            keep = r.keep(*[F.col(f"{k}{i}") for k in ("n", *sums)]) & (F.col(f"waste{i}") > 0)
            found = F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(f"n{i}").alias("n"), F.col(f"waste{i}").alias("waste"))
            each.append(F.when((F.col(f"n{i}") > 0) & keep, found))
        parts.append(e.agg(*aggs).select(F.inline(F.array_compact(F.array(*each)))))
    return reduce(DataFrame.unionByName, [*parts, *[plan(e) for plan in plans]])


def findings(entries: DataFrame, row_rules=ROW_RULES, plans=PLANS) -> DataFrame:
    """(rule, severity, n, waste_usd), dearest first, then by severity and name."""
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    out = _found(priced(entries), row_rules, plans).orderBy(F.desc("waste"), F.desc(rank[F.col("severity")]), "rule")
    return out.select("rule", "severity", "n", usd(F.col("waste")).alias("waste_usd"))


def headline(entries: DataFrame, row_rules=ROW_RULES, plans=PLANS) -> DataFrame:
    """Waste of all findings, no more than was spent."""
    e = priced(entries)
    w = _found(e, row_rules, plans).agg(F.coalesce(F.sum("waste"), F.lit(0)).alias("w"))
    s = e.agg(F.coalesce(F.sum("nano"), F.lit(0)).alias("s"))
    return w.join(F.broadcast(s)).select(usd(F.least("w", "s")).alias("waste_usd"))  # one row each
