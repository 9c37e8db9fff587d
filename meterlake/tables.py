"""Cut points in the folder that all executors share, and row numbers over whole tables without one big task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine, where it is unset, a new folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="meterlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written as a table and read back: lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, *order: Column | str, name: str = "seq", start: int = 0) -> DataFrame:
    """``rows`` with their place in order, from ``start``: sorted over all tasks by range, then counted a task at a time."""
    local = 33  # bits of a row's place within its task
    d = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    d = cut(d, "ordered").withColumn("_task", F.shiftright("_at", local))
    counts = d.groupBy("_task").count()  # a row for each task
    before = F.coalesce(F.sum("count").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(F.broadcast(counts.select("_task", before.alias("_before"))), "_task")
    return d.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << local) - 1) + start).drop("_at", "_task", "_before")
