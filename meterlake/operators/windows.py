"""Rolling spend, running totals, first occurrences and repeats, without a single-task window.

A global RANGE window would sort all facts in one task.  Here every row goes to its own time bucket
and to the next one as context, so each bucket is a partition of its own and holds all that a
window as long as a bucket can reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.operators.reports import usd
from meterlake.plans.ratecard import priced


def seconds() -> Column:
    """Whole microseconds since the epoch of a timestamp without zone, as seconds' millionths."""
    return F.unix_micros(F.col("ts").cast("timestamp"))


def in_window(facts: DataFrame, amount: Column, span_s: int, *by: str) -> DataFrame:
    """``facts`` with the sum (``windowed``) and count (``windowed_n``) of ``amount`` over the
    trailing ``span_s`` seconds, both ends included, optionally by keys.  ``amount`` is a whole number, never null.

    A window that slides is summed anew at each time, so a dense bucket would cost the square of its rows.  Here a row
    comes into its own bucket, stands in the next one from its start, and leaves it as the window passes: running sums alone."""
    span = span_s * 1_000_000
    d = facts.withColumn("_t", seconds()).withColumn("_v", amount).withColumn("_home", F.floor(F.col("_t") / span))
    turn = lambda own, bucket, at: F.struct(F.lit(own).alias("own"), bucket.alias("bucket"), at.alias("at"))
    d = d.withColumn("_e", F.explode(F.array(turn(True, F.col("_home"), F.col("_t")), turn(False, F.col("_home") + 1, F.col("_t") + span + 1))))
    d = d.select("*", "_e.*").drop("_e").withColumnsRenamed({"own": "_own", "bucket": "_bucket", "at": "_at"})
    w = Window.partitionBy(*by, "_bucket").orderBy("_at")
    whole, so_far = w.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing), w.rangeBetween(Window.unboundedPreceding, 0)
    own = F.col("_own")

    def total(x: Column) -> Column:
        return F.sum(F.when(own, F.lit(0)).otherwise(x)).over(whole) + F.sum(F.when(own, x).otherwise(-x)).over(so_far)

    d = d.withColumns({"windowed": total(F.col("_v")), "windowed_n": total(F.lit(1))})
    return d.filter("_own").drop("_t", "_v", "_home", "_own", "_bucket", "_at")


def rolling_hour(facts: DataFrame) -> DataFrame:
    d = in_window(priced(facts), F.col("nano"), 3600)
    return d.select("id", usd(F.col("windowed")).alias("hour_usd"))


def burn_rate(facts: DataFrame, minutes: int = 15) -> DataFrame:
    m = min(max(minutes, 1), 60)
    d = in_window(priced(facts), F.col("nano"), m * 60)
    return d.select("id", usd(F.col("windowed") * 60 / m).alias("per_hour"))


def running(facts: DataFrame, period: str = "day") -> DataFrame:
    """Running spend of the day, month or session, in billionths of a dollar.  Within small steps (hours of a day,
    days of a month) rows are summed in order; the steps before are added from a sum a step."""
    d = priced(facts)
    if period == "session":
        own = d.filter("session_id is not null and session_id <> ''")
        spent = F.sum("nano").over(Window.partitionBy("session_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0))
        return own.select("id", "session_id", spent.alias("spent"))
    span, step = {"day": (F.col("day"), F.hour("ts")), "month": (F.trunc("day", "month"), F.col("day"))}[period]
    d = d.withColumn("span", span).withColumn("step", step)
    inside = F.sum("nano").over(Window.partitionBy("span", "step").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0))
    steps = d.groupBy("span", "step").agg(F.sum("nano").alias("h"))
    before = F.sum("h").over(Window.partitionBy("span").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.select("span", "step", F.coalesce(before, F.lit(0)).alias("before"))  # at most 31 rows a span
    return d.withColumn("inside", inside).join(steps, ["span", "step"]).select("id", (F.col("inside") + F.col("before")).alias("spent"))


def budget_status(spent: Column, limit: Column, warn_percent: float = 80) -> Column:
    return F.when(limit <= 0, "off").when(spent >= limit, "exceeded").when(spent * 100 >= limit * warn_percent, "warn").otherwise("ok")


def daily_budget(facts: DataFrame, limit: float, warn_percent: float = 80) -> DataFrame:
    d = priced(facts).groupBy("day").agg(usd(F.sum("nano")).alias("spent"))
    return d.select("day", "spent", budget_status(F.col("spent"), F.lit(limit), warn_percent).alias("status"))


def repeats(facts: DataFrame, *by: str, span_s: int = 300, threshold: int = 5) -> DataFrame:
    """Calls of a key that make the threshold within the span (all arrivals count)."""
    d = in_window(facts, F.lit(1), span_s, *by)
    return d.filter(F.col("windowed_n") >= threshold).select("id", *by, F.col("windowed_n").alias("n"))


def spirals(facts: DataFrame, cap: float, span_s: int = 300) -> DataFrame:
    d = in_window(priced(facts), F.col("nano"), span_s)
    return d.filter(usd(F.col("windowed")) > cap).select("id", usd(F.col("windowed")).alias("spent"))


def changes(facts: DataFrame, key: str, value: str) -> DataFrame:
    """Rows at which the value of a key differs from the one before."""
    was = F.lag(value).over(Window.partitionBy(key).orderBy("ts", "id"))
    return facts.withColumn("was", was).filter(F.col("was").isNotNull() & (F.col("was") != F.col(value))).select("id", key, "was", value)


def nth(facts: DataFrame, key: str, n: int) -> DataFrame:
    """The n-th row of each key: the first occurrence, or the one that alerts."""
    d = facts.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("ts", "id")))
    return d.filter(F.col("k") == n).select(key, "id")
