"""Team usage: pace, members, chats, medians and fitted token rates, for all users at once."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLS = ["input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens"]
MIN_EVENTS = 20


def between(events: DataFrame, start: str, end: str) -> DataFrame:
    return events.filter((F.col("day") >= F.lit(start).cast("date")) & (F.col("day") < F.lit(end).cast("date")))


def pace_status(spent: Column, projected: Column, limit: Column, watch: float = 0.8) -> Column:
    return F.when(spent >= limit, "over_limit").when(projected >= limit, "over_pace").when(projected >= watch * limit, "watch").otherwise("ok")


def overview(events: DataFrame, members: DataFrame, start: str, end: str, elapsed_days: float, period_days: int) -> DataFrame:
    """Every member that isn't removed, idle ones at 0, with the period's projection."""
    spent = between(events, start, end).groupBy(F.col("user_email").alias("email")).agg(F.sum("charged_cents").alias("c"), F.count("*").alias("n"))
    d = members.filter("coalesce(is_removed, 0) = 0").join(spent, "email", "left")
    d = d.withColumn("spent", F.round(F.coalesce("c", F.lit(0.0)) / 100, 6)).withColumn("projected", F.round(F.col("spent") / max(elapsed_days, 1.0) * period_days, 6))
    return d.select("email", "spent", F.coalesce("n", F.lit(0)).alias("prompts"), "projected", pace_status(F.col("spent"), F.col("projected"), F.col("limit_dollars")).alias("status"))


def median_per_prompt(events: DataFrame, start: str, end: str, least: int = 5) -> DataFrame:
    u = between(events, start, end).groupBy("user_email").agg(F.sum("charged_cents").alias("c"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return u.agg(F.round(F.median(F.col("c") / F.col("n")), 6).alias("cents"))


def daily_series(events: DataFrame, start: str, end: str) -> DataFrame:
    """Each user's days of the period, gaps at 0, with the running sum."""
    e = between(events, start, end)
    users = e.select("user_email").distinct()
    days = users.select("user_email", F.explode(F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))).alias("day"))
    s = e.groupBy("user_email", "day").agg(F.sum("charged_cents").alias("c"))
    d = days.join(s, ["user_email", "day"], "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    run = F.sum("c").over(Window.partitionBy("user_email").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return d.select("user_email", "day", F.round("c", 6).alias("cents"), F.round(run, 6).alias("running"))


def top_chats(events: DataFrame, start: str, end: str, k: int = 5) -> DataFrame:
    """Each user's dearest chats of the period, with their span over all time."""
    s = between(events, start, end).groupBy("user_email", "conversation_id").agg(F.round(F.sum("charged_cents"), 6).alias("cents"))
    rank = F.row_number().over(Window.partitionBy("user_email").orderBy(F.desc("cents"), "conversation_id"))
    top = s.withColumn("rank", rank).filter(F.col("rank") <= k)
    every = events.groupBy("conversation_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return top.join(every, "conversation_id").select("user_email", "conversation_id", "cents", "rank", "first_ts", "last_ts", "n")


def family(model: Column) -> Column:
    """A model's name without suffixes of effort and speed (a fixed pattern)."""
    return F.regexp_replace(model, r"(-thinking)?(-(low|medium|high|xhigh|max))?(-thinking)?(-fast)?$", "")


def by_family(events: DataFrame) -> DataFrame:
    f = events.groupBy(family(F.col("model")).alias("family"), F.contains("model", F.lit("-fast")).alias("fast"))
    return f.agg(F.round(F.coalesce(F.sum("charged_cents"), F.lit(0.0)), 6).alias("cents"), F.count("*").alias("n"))


def free_use(events: DataFrame) -> DataFrame:
    """First sight, uses and share of free uses of each model."""
    free = F.count_if(F.col("kind") == "Free")
    return events.groupBy("model").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"), free.alias("free"), F.round(free / F.count("*"), 9).alias("share"))


def moments(events: DataFrame) -> DataFrame:
    """Sums for a least-squares fit of dollars on millions of tokens, by model; they add up over models."""
    x = [F.col(c) / 1e6 for c in COLS]
    y = F.col("charged_cents") / 100
    sums = [F.count("*").alias("n"), F.sum(y * y).alias("yy")]
    sums += [F.sum(x[i] * x[j]).alias(f"xx{i}{j}") for i in range(4) for j in range(i, 4)]
    sums += [F.sum(x[i] * y).alias(f"xy{i}") for i in range(4)] + [F.sum(x[i]).alias(f"x{i}") for i in range(4)]
    return events.filter("charged_cents > 0").groupBy("model").agg(*sums)


def fit(m: pd.Series) -> list[float] | None:
    """Non-negative rates of least squared error: the best of the sets of columns that may be positive."""
    if m["n"] < MIN_EVENTS:
        return None
    xx = np.array([[m[f"xx{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)])
    xy = np.array([m[f"xy{i}"] for i in range(4)])
    used, best = [i for i in range(4) if m[f"x{i}"] > 0], (np.inf, None)
    for on in (c for k in range(1, len(used) + 1) for c in combinations(used, k)):
        part = xx[np.ix_(on, on)]
        if np.linalg.matrix_rank(part, tol=1e-12) < len(on) or (r := np.linalg.solve(part, xy[list(on)])).min() < 0:
            continue
        full = np.zeros(4)
        full[list(on)] = r
        best = min(best, (m["yy"] - 2 * full @ xy + full @ xx @ full, full.tolist()), key=lambda b: b[0])
    return best[1]


def fitted_rates(events: DataFrame) -> DataFrame:
    """Dollars a million tokens, by model; the events are summed in Spark, a model is one row of moments."""
    def run(batches):
        for m in batches:
            rates = [fit(row) for _, row in m.iterrows()]
            yield pd.DataFrame({"model": m["model"], **{f"rate_{c}": [r[i] if r else None for r in rates] for i, c in enumerate(COLS)}})
    return moments(events).mapInPandas(run, "model string, " + ", ".join(f"rate_{c} double" for c in COLS))


#: Relative weights of a model without a fit; windows of days to fit, and the prompts that one should have.
FALLBACK = [1.0, 5.0, 1.25, 0.1]
FIT_WINDOWS, PREFER_EVENTS, WEEK_PROMPTS = (7, 14, 30), 100, 7


def is_fast(model: Column) -> Column:
    return model.endswith("-fast")


def version(name: Column) -> tuple[Column, Column]:
    """A family's name without its version, and the version as numbers: the first run of numeric parts."""
    parts = F.split(name, "-")
    numeric = F.transform(parts, lambda p: p.rlike(r"^[0-9]+(\.[0-9]+)*$"))
    first = F.array_position(numeric, F.lit(True)).cast("int")  # from 1; 0: unversioned
    rest = F.slice(numeric, first, F.size(parts))
    run = F.when(F.array_contains(rest, F.lit(False)), F.array_position(rest, F.lit(False)).cast("int") - 1).otherwise(F.size(rest))
    stem = F.array_join(F.concat(F.slice(parts, F.lit(1), first - 1), F.slice(parts, first + run, F.size(parts))), "-")
    numbers = F.transform(F.flatten(F.transform(F.slice(parts, first, run), lambda p: F.split(p, r"\."))), lambda x: x.cast("int"))
    known = (first > 0) & F.when(first > 0, stem != "")
    return F.when(known, stem), F.when(known, numbers)


def _trailing(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """Events of the days before ``as_of``."""
    return between(events, "1970-01-01", as_of).filter(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), days))


def fit_windows(events: DataFrame, as_of: str) -> DataFrame:
    """(model, days, n): the shortest window with prompts enough, else the longest."""
    e = _trailing(events, as_of, FIT_WINDOWS[-1]).filter("charged_cents > 0")
    n = [F.count_if(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), d)).alias(f"n{d}") for d in FIT_WINDOWS]
    days = count = None
    for d in reversed(FIT_WINDOWS):
        enough = F.col(f"n{d}") >= PREFER_EVENTS
        days = F.lit(d) if days is None else F.when(enough, d).otherwise(days)
        count = F.col(f"n{d}") if count is None else F.when(enough, F.col(f"n{d}")).otherwise(count)
    return e.groupBy("model").agg(*n).select("model", days.alias("days"), count.alias("n"))


def window_moments(events: DataFrame, as_of: str) -> DataFrame:
    """Moments of each model over its window; models are few, so their windows are a small side."""
    e = _trailing(events, as_of, FIT_WINDOWS[-1]).join(fit_windows(events, as_of).select("model", "days"), "model")
    return moments(e.filter(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), F.col("days"))))


def family_moments(by_model: DataFrame) -> DataFrame:
    """Moments added up by family and speed."""
    by = by_model.groupBy(family(F.col("model")).alias("family"), is_fast(F.col("model")).alias("fast"))
    return by.agg(*[F.sum(c).alias(c) for c in by_model.columns if c != "model"])


def _fits(m: DataFrame, keys: str) -> DataFrame:
    """(keys, r): the rates of each row of moments, null without a fit."""
    names = [k.split()[0] for k in keys.split(", ")]

    def run(batches):
        for b in batches:
            yield pd.DataFrame({**{k: b[k] for k in names}, "r": [fit(row) for _, row in b.iterrows()]})

    return m.mapInPandas(run, f"{keys}, r array<double>")


def rates(events: DataFrame, as_of: str) -> DataFrame:
    """(model, r): each model's own fitted rates, else those of its family at the same speed, else null."""
    m = window_moments(events, as_of)
    own = _fits(m, "model string").withColumn("family", family(F.col("model"))).withColumn("fast", is_fast(F.col("model")))
    fam = _fits(family_moments(m), "family string, fast boolean").withColumnRenamed("r", "fr")
    return own.join(fam, ["family", "fast"], "left").select("model", F.coalesce("r", "fr").alias("r"))


def charge_split(events: DataFrame, fitted: DataFrame, *by: str) -> DataFrame:
    """Charges by type of token, in proportion to rate times tokens, and what has no tokens; ``fitted``: (model, r)."""
    e = events.filter("charged_cents > 0").join(fitted, "model", "left")
    t = F.array(*[F.coalesce(c, F.lit(0)).cast("double") for c in COLS])
    e = e.withColumn("t", t).withColumn("w", F.zip_with(F.coalesce("r", F.array(*map(F.lit, FALLBACK))), "t", lambda a, b: a * b))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    e = e.withColumn("w", F.when(total(F.col("w")) > 0, F.col("w")).otherwise(F.col("t"))).withColumn("all", total(F.col("w")))
    cents = [F.sum(F.when(F.col("all") > 0, F.col("charged_cents") * F.col("w")[i] / F.col("all")).otherwise(0.0)).alias(f"c{i}") for i in range(4)]
    sums = [F.sum(F.col("t")[i]).alias(f"t{i}") for i in range(4)]
    other = F.sum(F.when(F.col("all") > 0, 0.0).otherwise(F.col("charged_cents"))).alias("c4")
    d = e.groupBy(*by).agg(*cents, *sums, other)
    rows = [F.struct(F.lit(c).alias("type"), F.col(f"t{i}").cast("long").alias("tokens"), F.round(F.col(f"c{i}") / 100, 2).alias("dollars")) for i, c in enumerate(COLS)]
    rows.append(F.struct(F.lit("other").alias("type"), F.lit(0).cast("long").alias("tokens"), F.round(F.col("c4") / 100, 2).alias("dollars")))
    return d.select(*by, F.inline(F.array(*rows)))


def fast_what_if(events: DataFrame, fitted: DataFrame, *by: str) -> DataFrame:
    """What fast models' tokens would cost at the normal speed; only differences of a dollar at least."""
    e = events.filter(is_fast(F.col("model")) & (F.col("charged_cents") > 0)).groupBy(*by, "model").agg(F.sum("charged_cents").alias("c"), *[F.sum(c).alias(c) for c in COLS])
    normal = e.withColumn("model", F.regexp_replace("model", "-fast$", "")).join(fitted.filter("r is not null"), "model")
    cost = sum((F.col("r")[i] * F.col(c) / 1e6 for i, c in enumerate(COLS)), F.lit(0.0))
    d = normal.groupBy(*by).agg(F.round(F.sum("c") / 100, 2).alias("actual"), F.round(F.sum(cost), 2).alias("normal"))
    return d.filter(F.col("actual") - F.col("normal") >= 1).withColumn("saving", F.round(F.col("actual") - F.col("normal"), 2))


def week_per_prompt(events: DataFrame, as_of: str) -> DataFrame:
    """Each user's cents a prompt over the seven days before."""
    e = _trailing(events, as_of, WEEK_PROMPTS).groupBy("user_email").agg(F.sum("charged_cents").alias("c"), F.count("*").alias("n"))
    return e.select("user_email", F.round(F.col("c") / F.col("n"), 6).alias("cents"), "n")


def free_periods(events: DataFrame, min_prompts: int = 50, share: float = 0.8) -> DataFrame:
    """(family, last_free): families that were almost always free up to an instant and charged since."""
    e = events.withColumn("family", family(F.col("model")))
    last = e.filter("kind = 'Free'").groupBy("family").agg(F.max("ts").alias("last_free"))
    upto = F.col("ts") <= F.col("last_free")
    d = e.join(last, "family").groupBy("family", "last_free").agg(
        F.count_if(upto & (F.col("kind") == "Free")).alias("free"), F.count_if(upto).alias("n"), F.count_if(~upto & (F.col("charged_cents") > 0)).alias("charged")
    )
    return d.filter((F.col("charged") > 0) & (F.col("free") >= min_prompts) & (F.col("free") >= share * F.col("n"))).select("family", "last_free")


def newest_families(events: DataFrame, as_of: str, days: int = 14, min_prompts: int = 20) -> DataFrame:
    """(family, newest): families in use of which a newer version has prompts enough."""
    e = _trailing(events, as_of, days).groupBy(family(F.col("model")).alias("family")).agg(F.count("*").alias("n"))
    stem, numbers = version(F.col("family"))
    e = e.withColumn("stem", stem).withColumn("v", numbers).filter("stem is not null")
    best = e.filter(F.col("n") >= min_prompts).groupBy("stem").agg(F.max(F.struct("v", "family")).alias("b"))
    return e.join(best, "stem").filter(F.col("v") < F.col("b.v")).select("family", F.col("b.family").alias("newest"))


def restart_excess(events: DataFrame, first: int = 5) -> DataFrame:
    """What each chat's later prompts cost above the mean of its first ones, by user."""
    by = Window.partitionBy("user_email", "conversation_id")
    e = events.withColumn("k", F.row_number().over(by.orderBy("ts", "id")))
    e = e.withColumn("base", F.avg(F.when(F.col("k") <= first, F.col("charged_cents"))).over(by))
    over = F.when(F.col("k") > first, F.greatest(F.col("charged_cents") - F.col("base"), F.lit(0.0))).otherwise(0.0)
    return e.groupBy("user_email").agg(F.round(F.sum(over), 4).alias("cents"))
