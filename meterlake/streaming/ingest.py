"""Appending, accumulating and replacing tables that can be written again without harm.

Each batch of a stream, and each sync of a source, owns a folder named by its number: a batch that is run again
overwrites its own rows, so replays change nothing, and nothing is read to write.  Readers put the parts together: rows
are appended, daily amounts are summed over batches, and of synced days the latest sync that covers a day counts, with
or without rows.  A sync is seen once its window is written, which is its last step.

Defined results: amounts that are null, not finite or not above zero are ignored; a sync without rows empties its days;
syncs are ordered by number.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException


def put_batch(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def projected(rows: DataFrame, day: str = "day", amount: str = "savings") -> DataFrame:
    """(day, savings) of a batch."""
    ok = (F.col(amount) > 0) & ~F.isnan(amount) & (F.col(amount) < float("inf"))
    return rows.filter(ok).groupBy(F.col(day).alias("day")).agg(F.sum(amount).alias("savings"))


def append_stream(rows: DataFrame, path: str, checkpoint: str, accumulate: bool = False) -> StreamingQuery:
    """Every batch into its folder of ``path``: as it is, or (``accumulate``) as daily amounts."""
    def put(batch: DataFrame, number: int) -> None:
        put_batch(projected(batch) if accumulate else batch, path, number)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulated(spark: SparkSession, path: str) -> DataFrame:
    """(day, savings) over all batches."""
    return spark.read.schema("day date, savings double, batch long").parquet(path).groupBy("day").agg(F.sum("savings").alias("savings"))


def put_sync(rows: DataFrame, path: str, number: int, start: datetime.date, end: datetime.date) -> None:
    """Rows (with ``day``) of the days from ``start`` to ``end``, both included, as the source has them now."""
    spark = rows.sparkSession
    rows.filter(F.col("day").between(F.lit(start), F.lit(end))).write.mode("overwrite").parquet(f"{path}/rows/sync={number}")
    spark.createDataFrame([(start, end)], "start date, end date").coalesce(1).write.mode("overwrite").parquet(f"{path}/windows/sync={number}")


def windows(spark: SparkSession, path: str) -> DataFrame | None:
    """(start, end, sync) of every sync; None before the first."""
    try:
        return spark.read.schema("start date, end date, sync long").parquet(f"{path}/windows")
    except AnalysisException:
        return None


def next_start(spark: SparkSession, path: str, first: datetime.date, overlap_days: int = 1) -> datetime.date:
    """Where the next sync starts: the last synced day, less what may still have changed."""
    done = windows(spark, path)
    last = None if done is None else done.agg(F.max("end")).first()[0]
    return first if last is None else last - datetime.timedelta(days=overlap_days)


def synced(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows as of the latest sync of each day."""
    days = windows(spark, path).select("sync", F.explode(F.sequence("start", "end")).alias("day"))
    valid = days.groupBy("day").agg(F.max("sync").alias("sync"))  # a row for each day
    rows = spark.read.schema(f"{schema}, sync long").parquet(f"{path}/rows")
    return rows.join(valid, ["day", "sync"], "left_semi").drop("sync")
