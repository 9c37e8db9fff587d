"""Plan windows told by reply headers: snapshots, the latest of each provider as of an instant, and the tightest window.

Defined results: a reply without a numeric five-hour utilization is no snapshot; other numbers that don't parse are 0; the
window that the provider calls binding comes first; of snapshots of one instant the one of the larger utilization counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefix of the headers, windows with their labels and names, and seconds until a snapshot is stale.
PREFIX, WINDOWS, STALE = "anthropic-ratelimit-unified-", [("5h", "five_hour"), ("7d", "seven_day")], 12 * 3600


def _number(headers: Column, name: str, kind: str) -> Column:
    return F.trim(headers[PREFIX + name]).try_cast(kind)


def snapshots(replies: DataFrame, headers: str = "headers", captured: str = "ts") -> DataFrame:
    """(provider, captured_at, status, windows) of replies provider, headers (lower-case names) and time."""
    h = F.col(headers)
    five, seven = (F.struct(F.lit(label).alias("label"), F.coalesce(_number(h, f"{label}-utilization", "double"), F.lit(0.0)).alias("utilization"), F.coalesce(_number(h, f"{label}-reset", "long"), F.lit(0)).cast("long").alias("reset")) for label, _ in WINDOWS)
    windows = F.when(h[PREFIX + "representative-claim"] == WINDOWS[1][1], F.array(seven, five)).otherwise(F.array(five, seven))
    known = (F.col("provider") == "anthropic") & _number(h, f"{WINDOWS[0][0]}-utilization", "double").isNotNull()
    return replies.filter(known).select("provider", F.col(captured).alias("captured_at"), F.coalesce(h[PREFIX + "status"], F.lit("allowed")).alias("status"), windows.alias("windows"))


def latest(snaps: DataFrame, as_of: Column, *by: str) -> DataFrame:
    """(provider, by, captured_at, status, windows, age_s, stale): each one's last snapshot that is not after ``as_of``."""
    order = F.struct("captured_at", F.col("windows")[0]["utilization"])
    d = snaps.filter(F.col("captured_at") <= as_of).groupBy("provider", *by).agg(F.max_by(F.struct("captured_at", "status", "windows"), order).alias("s"))
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("captured_at").cast("timestamp"))
    return d.select("provider", *by, "s.*").withColumn("age_s", age).withColumn("stale", F.col("age_s") > STALE)


def freshest(of_each: DataFrame) -> DataFrame:
    """The one row of the newest snapshot that isn't stale; none if all are."""
    fields = [F.col(c) for c in of_each.columns]
    return of_each.filter("not stale").agg(F.max_by(F.struct(*fields), F.struct("captured_at", "provider")).alias("s")).filter("s is not null").select("s.*")


def tightest(of_each: DataFrame) -> DataFrame:
    """(provider, label, utilization): the binding window that is fullest, over all providers."""
    w = of_each.select("provider", F.col("windows")[0].alias("w"))
    one = w.agg(F.max_by(F.struct("provider", "w.label", "w.utilization"), F.struct("w.utilization", "provider")).alias("x"))
    return one.filter("x is not null").select("x.*")
