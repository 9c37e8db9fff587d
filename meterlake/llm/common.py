"""Shared ground for the corpus operators: session settings, cut points, components.

Every operator takes DataFrames and returns DataFrames.  Nothing here collects
rows of a corpus; the driver only ever sees counters.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, whichever is reached first.  Texts can be long, so batches are kept short.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that the Arrow stages need: short batches, so that long texts fit.  They stay set, since
    the returned frames run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; on one machine, where it is unset, a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="meterlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here,
    and a lost executor costs only the tasks it ran."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list, as rows (node, component = smallest node).

    Alternating large-star and small-star steps: each is one aggregate and one join, so a hub
    with many neighbours is pre-aggregated and never gathered.  Ends when a round changes
    nothing (compared by count and two order-free sums).  Nodes without edges are absent.
    """
    e = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u is not null and v is not null and u <> v").distinct(),
        "edges",
    )

    def mark(e: DataFrame) -> tuple:
        return tuple(
            e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v", "u") % 998244353)).first()
        )

    def star(e: DataFrame, large: bool) -> DataFrame:
        """large: each larger neighbour of u moves to u's smallest; else each smaller one."""
        if large:
            n = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = n.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            out = n.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            low = e.groupBy("u").agg(F.min("v").alias("m"))
            hops = e.join(low, "u")
            out = hops.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                low.select("u", F.col("m").alias("v"))
            )
        return out.filter("u <> v").distinct()

    seen = mark(e)
    while seen[0]:
        e = cut(star(star(e, True), False), "edges")
        now = mark(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
