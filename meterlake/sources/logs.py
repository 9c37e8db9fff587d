"""Usage entries from four tools' session logs, by Spark's text reader.

Lines that can't be read give no row.  A file's lines keep their order by (file, line); files are
read whole where order matters, so that no split loses a line's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = ["tool", "model", "timestamp", "input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens", "reasoning_tokens", "session_id", "workspace", "context_window"]


def lines(spark: SparkSession, path: str, suffix: str = "jsonl", modified_after: str | None = None) -> DataFrame:
    """(file, line, value) of the files under ``path``; older files are pruned before they are opened."""
    r = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}")
    r = r.option("modifiedAfter", modified_after) if modified_after else r
    files = r.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("mtime"), "value")
    return files.select("file", "mtime", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))


def _count(x: Column) -> Column:
    return F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)).cast("bigint")


def _entry(d: DataFrame, **columns: Column) -> DataFrame:
    nothing = {"reasoning_tokens": F.lit(0), "cache_creation_tokens": F.lit(0), "cache_read_tokens": F.lit(0), "session_id": F.lit(None), "workspace": F.lit(None), "context_window": F.lit(None)}
    kinds = {c: "bigint" for c in ENTRY if c.endswith("tokens") or c == "context_window"} | {"timestamp": "timestamp"}
    columns = nothing | columns
    return d.select(*[columns[c].cast(kinds.get(c, "string")).alias(c) for c in ENTRY])


def assistant_events(text: DataFrame) -> DataFrame:
    """Source 1: assistant turns; a turn repeated in any file counts where it stands first."""
    usage = "usage struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>"
    schema = f"type string, timestamp string, requestId string, sessionId string, cwd string, message struct<id:string,model:string,{usage.replace(' ', ':', 1)}>"
    d = text.select("file", "line", F.from_json("value", schema).alias("j")).filter("j.type = 'assistant' and j.message.model is not null and j.message.usage is not null")
    d = d.withColumn("t", F.try_to_timestamp("j.timestamp")).filter("t is not null").withColumn("key", F.concat("j.message.id", F.lit(":"), "j.requestId"))
    unkeyed = d.filter("key is null")  # apart: one null key would gather them all in one window
    first = F.row_number().over(Window.partitionBy("key").orderBy("file", "line"))
    kept = d.filter("key is not null").withColumn("k", first).filter("k = 1").drop("k").unionByName(unkeyed)
    u = F.col("j.message.usage")
    return _entry(
        kept, tool=F.lit("source-1"), model=F.col("j.message.model"), timestamp=F.col("t"), input_tokens=_count(u["input_tokens"]), output_tokens=_count(u["output_tokens"]),
        cache_creation_tokens=_count(u["cache_creation_input_tokens"]), cache_read_tokens=_count(u["cache_read_input_tokens"]), session_id=F.col("j.sessionId"), workspace=F.col("j.cwd"),
    )


def sticky_context(text: DataFrame) -> DataFrame:
    """Source 2: usage lines take model, folder and session from the context lines before them."""
    last = "last_token_usage:struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,reasoning_output_tokens:bigint>"
    schema = f"timestamp string, type string, payload struct<id:string,model:string,cwd:string,type:string,info:struct<{last},model_context_window:bigint>>"
    d = text.select("file", "line", F.from_json("value", schema).alias("j"))
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    meta = F.col("j.type").isin("session_meta", "turn_context")
    for c in ("id", "model", "cwd"):
        d = d.withColumn(f"_{c}", F.last(F.when(meta, F.col(f"j.payload.{c}")), ignorenulls=True).over(before))
    u = F.col("j.payload.info.last_token_usage")
    day = F.regexp_extract("file", r"/([0-9]{4})/([0-9]{2})/([0-9]{2})/", 0)
    t = F.coalesce(F.try_to_timestamp("j.timestamp"), F.try_to_timestamp(F.concat(F.replace(F.trim(day, F.lit("/")), F.lit("/"), F.lit("-")), F.lit(" 12:00:00"))))
    d = d.filter("j.payload.type = 'token_count'").withColumn("u", u).withColumn("t", t).filter("u is not null and t is not null and _model is not null")
    fresh, cached, out = _count(F.col("u.input_tokens") - _count(F.col("u.cached_input_tokens"))), _count(F.col("u.cached_input_tokens")), _count(F.col("u.output_tokens"))
    d = d.withColumn("fresh", fresh).withColumn("cached", cached).withColumn("out", out).filter("fresh + cached + out > 0")
    w = F.col("j.payload.info.model_context_window")
    return _entry(
        d, tool=F.lit("source-2"), model=F.col("_model"), timestamp=F.col("t"), input_tokens=F.col("fresh"), cache_read_tokens=F.col("cached"), output_tokens=F.col("out"),
        reasoning_tokens=_count(F.col("u.reasoning_output_tokens")), session_id=F.col("_id"), workspace=F.col("_cwd"), context_window=F.when(w > 0, w),
    )


def one_object_files(spark: SparkSession, path: str) -> DataFrame:
    """Source 3: one message a file."""
    schema = "role string, sessionID string, modelID string, tokens struct<input:bigint,output:bigint,reasoning:bigint,cache:struct<read:bigint,write:bigint>>, time struct<created:bigint,completed:bigint>"
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    d = files.select(F.from_json("value", schema).alias("j"), F.col("_metadata.file_modification_time").alias("mtime")).filter("j.modelID is not null and j.tokens is not null")
    u, at = F.col("j.tokens"), F.coalesce("j.time.completed", "j.time.created")
    d = d.filter(_count(u["input"]) + _count(u["output"]) + _count(u["cache"]["read"]) + _count(u["cache"]["write"]) > 0)
    return _entry(
        d, tool=F.lit("source-3"), model=F.col("j.modelID"), timestamp=F.coalesce(F.timestamp_millis(at), F.col("mtime")), input_tokens=_count(u["input"]), output_tokens=_count(u["output"]),
        cache_creation_tokens=_count(u["cache"]["write"]), cache_read_tokens=_count(u["cache"]["read"]), reasoning_tokens=_count(u["reasoning"]), session_id=F.col("j.sessionID"),
    )


def sent_messages(text: DataFrame) -> DataFrame:
    """Source 4: one event a sent message, epoch seconds, provider before the model's name."""
    schema = "event string, time bigint, properties struct<main_model:string,prompt_tokens:bigint,completion_tokens:bigint>"
    d = text.select(F.from_json("value", schema).alias("j")).filter("j.event = 'message_send' and j.properties.main_model is not null and j.time is not null")
    p = F.col("j.properties")
    d = d.filter(_count(p["prompt_tokens"]) + _count(p["completion_tokens"]) > 0)
    return _entry(d, tool=F.lit("source-4"), model=F.regexp_replace(p["main_model"], r"^[^/]*/(?=.)", ""), timestamp=F.timestamp_seconds("j.time"), input_tokens=_count(p["prompt_tokens"]), output_tokens=_count(p["completion_tokens"]))


def union(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out
