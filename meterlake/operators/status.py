"""The day's status: attribution, combined spend, baselines, hourly average, statuses by severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.operators.reports import daily_totals, since, under, usd
from meterlake.plans.ratecard import nano, priced, prompt_tokens, resolve, cost

#: The provider that stands behind a tool's logs.
TOOL_PROVIDERS = {"claude-code": "anthropic", "codex": "openai"}
TOKENS = ["input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens"]


def in_repository(workspace: Column, root: str | None) -> Column:
    """Without a root every entry counts; with one, entries without a workspace don't."""
    return F.lit(True) if root is None else F.coalesce(under(workspace, F.lit(root)), F.lit(False))


def attributed(entries: DataFrame, root: str | None, since_ts: str | None) -> DataFrame:
    kept = entries.filter(in_repository(F.col("workspace"), root))
    return kept if since_ts is None else kept.filter(F.col("ts") >= F.lit(since_ts).cast("timestamp_ntz"))


def attribution(entries: DataFrame, root: str | None = None, since_ts: str | None = None) -> DataFrame:
    """Cost and turns of a repository's entries from an instant on, by tool and model, dearest first."""
    by = priced(attributed(entries, root, since_ts)).groupBy("tool", "model")
    return by.agg(usd(F.sum("nano")).alias("cost_usd"), F.count("*").alias("turns")).orderBy(F.desc("cost_usd"), "tool", "model")


def attribution_totals(entries: DataFrame, root: str | None = None, since_ts: str | None = None) -> DataFrame:
    return priced(attributed(entries, root, since_ts)).agg(usd(F.sum("nano")).alias("cost_usd"), F.count("*").alias("turns"))


def combined_today(facts: DataFrame, entries: DataFrame, providers: dict[str, str] = TOOL_PROVIDERS) -> DataFrame:
    """A day's spend: calls that were proxied, and logs of tools whose provider wasn't; both sides are of that day.
    Log tokens are summed by tool and model before they are priced."""
    wire = priced(facts)
    proxied = wire.filter(~F.col("blocked")).groupBy("provider").agg(F.sum("nano").alias("p")).filter("p > 0").select("provider")
    of = F.lit(None).cast("string")
    for tool, provider in providers.items():
        of = F.when(F.col("tool") == tool, provider).otherwise(of)
    logs = resolve(entries.groupBy("tool", "model").agg(*[F.sum(t).alias(t) for t in TOKENS])).select("tool", nano(cost()).alias("nano"))
    alone = logs.withColumn("provider", of).join(proxied, "provider", "left_anti")
    both = wire.select(F.lit("wire").alias("side"), "nano").unionByName(alone.select(F.lit("logs").alias("side"), "nano"))
    side = lambda s: usd(F.sum(F.when(F.col("side") == s, F.col("nano"))))
    return both.agg(side("wire").alias("proxied_usd"), side("logs").alias("logs_usd"), usd(F.sum("nano")).alias("cost_usd"))


def previous_day(facts: DataFrame, as_of: str) -> DataFrame:
    """Yesterday's spend, cache hits of what was not blocked, and blocked calls."""
    d = priced(facts.filter(F.col("day") == F.date_sub(F.lit(as_of).cast("date"), 1)))
    open_ = ~F.col("blocked")
    read, prompt = F.sum(F.when(open_, F.col("cache_read_tokens"))), F.sum(F.when(open_, prompt_tokens()))
    return d.agg(usd(F.sum("nano")).alias("cost_usd"), F.round(F.when(prompt > 0, read / prompt * 100).otherwise(0.0), 9).alias("hit_pct"), F.count_if("blocked").alias("blocked"))


def prior_window(facts: DataFrame, as_of: str, days: int) -> DataFrame:
    """The days before a window of as many days: spend, blocked calls, and the plain mean of the days' hit rates."""
    before = daily_totals(since(facts, as_of, 2 * days)).filter(F.col("day") < F.date_sub(F.lit(as_of).cast("date"), days - 1))
    return before.agg(
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"), F.round(F.coalesce(F.avg("hit_rate"), F.lit(0.0)) * 100, 6).alias("hit_pct"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked")
    )


def hourly_average(facts: DataFrame, now: str) -> DataFrame:
    """The day's spend up to now an hour, from five minutes on."""
    t = F.lit(now).cast("timestamp_ntz")
    hours = F.greatest((F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / 3600, F.lit(5 / 60))
    d = priced(facts.filter((F.col("day") == t.cast("date")) & (F.col("ts") <= t))).agg(F.coalesce(F.sum("nano"), F.lit(0)).alias("s"))
    return d.select(usd(F.col("s")).alias("spent"), usd(F.floor(F.col("s") / hours)).alias("per_hour"))


def last_call(facts: DataFrame, now: str, idle_s: int = 3600) -> DataFrame:
    """Each session's newest call that was not blocked, and whether it is idle."""
    newest = facts.filter(~F.col("blocked") & F.col("session_id").isNotNull()).groupBy("session_id").agg(F.max(F.struct("ts", "id", "model", prompt_tokens().alias("prompt"))).alias("x"))
    quiet = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("x.ts").cast("timestamp"))
    return newest.select("session_id", "x.id", "x.model", "x.prompt", (quiet > idle_s * 1_000_000).alias("idle"))
