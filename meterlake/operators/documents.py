"""Exports: CSV with fixed digits, JSON lines of spans, replace-by-day tables, and findings documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.plans.ratecard import priced


def write_csv(df: DataFrame, path: str, digits: dict[str, int] | None = None) -> None:
    """Quoted as RFC 4180 has it; money with fixed digits."""
    out = df.withColumns({c: F.format_string(f"%.{n}f", F.col(c)) for c, n in (digits or {}).items()})
    out.write.csv(path, header=True, escape='"', quote='"')


#: What the conventions call a provider.
SYSTEMS = {"google": "gcp.gemini"}


def spans(facts: DataFrame) -> DataFrame:
    """A span for each call, with the usual attribute names; cost, cache and latency have names of our own.  Status 2 is an
    error, 1 is none.  Calls of a session are one trace; ids are hashes, so a call has the same ones each time."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    latency = F.greatest(F.coalesce("latency_ms", F.lit(0)), F.lit(0)).cast("long")
    system = F.col("provider")
    for own, name in SYSTEMS.items():
        system = F.when(F.col("provider") == own, name).otherwise(system)
    trace = F.coalesce(F.concat(F.lit("session "), F.nullif("session_id", F.lit(""))), F.concat(F.lit("call "), F.col("id").cast("string")))
    named = {
        "gen_ai.operation.name": F.lit("chat"), "gen_ai.system": system, "gen_ai.request.model": F.col("model"), "gen_ai.response.model": F.col("model"),
        "gen_ai.usage.input_tokens": F.col("input_tokens"), "gen_ai.usage.output_tokens": F.col("output_tokens"), "meterlake.usage.cache_read_tokens": F.col("cache_read_tokens"),
        "meterlake.usage.cache_creation_tokens": F.col("cache_creation_tokens"), "meterlake.cost_usd": F.col("cost_usd"), "meterlake.latency_ms": latency, "http.response.status_code": F.col("http_status"),
    }
    error = F.coalesce((F.col("http_status") == 0) | (F.col("http_status") >= 400), F.lit(False))
    return priced(facts).select(
        F.concat(F.lit("chat "), "model").alias("name"), F.left(F.sha2(trace, 256), F.lit(32)).alias("trace_id"), F.left(F.sha2(F.concat(F.lit("span "), F.col("id").cast("string")), 256), F.lit(16)).alias("span_id"),
        F.lit("SPAN_KIND_CLIENT").alias("kind"), start.cast("string").alias("start_time_unix_nano"), (start + latency * 1_000_000).cast("string").alias("end_time_unix_nano"),
        F.struct(F.when(error, 2).otherwise(1).alias("code")).alias("status"), F.struct(*(v.alias(k) for k, v in named.items())).alias("attributes"),
    )


def write_spans(facts: DataFrame, path: str) -> None:
    """One JSON object a call."""
    d = spans(facts)
    d.select(F.to_json(F.struct(*d.columns)).alias("value")).write.text(path)


def replace_days(events: DataFrame, path: str) -> None:
    """The days that ``events`` has replace those of the table; other days stay."""
    events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``old`` whose key ``new`` lacks, and those of ``new``."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def sarif(findings: DataFrame, tool: str = "meterlake") -> str:
    """A findings document; its findings are what someone reads, so they are few and end at the driver."""
    rows = findings.select("path", "line", "rule", "level").orderBy("path", "line").collect()
    rules = [{"id": r} for r in sorted({x["rule"] for x in rows})]
    results = [{"ruleId": x["rule"], "level": x["level"], "message": {"text": x["rule"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": x["path"]}, "region": {"startLine": x["line"]}}}]} for x in rows]
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}]})


def bill_of_materials(digest: DataFrame) -> str:
    """Models in use as components, from `reports.digest`'s row."""
    models = (digest.first()["models"] or "").split(",")
    return json.dumps({"bomFormat": "CycloneDX", "specVersion": "1.6", "components": [{"type": "machine-learning-model", "name": m} for m in models if m]})
