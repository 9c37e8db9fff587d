"""Usage counters from providers' response bodies, whole JSON documents or event streams.

A body becomes an array of JSON payloads (itself, or its ``data: `` lines) and is folded by
higher-order functions within its row: no shuffle, and a body that can't be read gives nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _payloads(body: Column) -> Column:
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: F.startswith(x, F.lit("data: ")))
    streamed = F.transform(lines, lambda x: F.substring(x, 7, 1 << 30))
    return F.when(F.try_parse_json(body).isNotNull(), F.array(body)).otherwise(F.filter(streamed, lambda x: F.try_parse_json(x).isNotNull()))


def _number(json: Column, path: str) -> Column:
    """A whole number that isn't negative, else 0."""
    raw = F.get_json_object(json, path)
    return F.greatest(F.coalesce(F.when(raw.rlike(r"^-?[0-9]+$"), raw.try_cast("bigint")), F.lit(0)), F.lit(0))


def _first_text(payloads: Column, *paths: str) -> Column:
    found = F.transform(payloads, lambda p: F.coalesce(*[F.get_json_object(p, x) for x in paths]))
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))


def _last(payloads: Column, keep) -> Column:
    return F.try_element_at(F.filter(payloads, keep), F.lit(-1))


def provider_one(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Separate cache counters; in streams the prompt's come first and the output's largest counts."""
    d = bodies.withColumn("_p", _payloads(F.col(body)))
    # a whole document has its usage at the top, a stream's first message under ``message``
    start = F.coalesce(_last(F.col("_p"), lambda p: F.get_json_object(p, "$.type") == "message_start"), F.try_element_at(F.filter("_p", lambda p: F.get_json_object(p, "$.usage").isNotNull() & F.get_json_object(p, "$.model").isNotNull()), F.lit(1)))
    d = d.withColumn("_s", start).withColumn("_u", F.coalesce(F.get_json_object("_s", "$.message.usage"), F.get_json_object("_s", "$.usage")))
    outputs = F.transform("_p", lambda p: F.greatest(_number(p, "$.usage.output_tokens"), _number(p, "$.message.usage.output_tokens")))
    model = _first_text(F.col("_p"), "$.message.model", "$.model")
    return _done(d, model, _number(F.col("_u"), "$.input_tokens"), _number(F.col("_u"), "$.cache_creation_input_tokens"), _number(F.col("_u"), "$.cache_read_input_tokens"), F.array_max(outputs), model.isNotNull())


def provider_two(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Two vocabularies, perhaps under ``response``; cached tokens are part of the prompt's."""
    d = bodies.withColumn("_p", F.transform(_payloads(F.col(body)), lambda p: F.coalesce(F.get_json_object(p, "$.response"), p)))

    def prompt(p: Column) -> Column:
        return F.greatest(_number(p, "$.usage.prompt_tokens"), _number(p, "$.usage.input_tokens"))

    def output(p: Column) -> Column:
        return F.greatest(_number(p, "$.usage.completion_tokens"), _number(p, "$.usage.output_tokens"))

    d = d.withColumn("_u", _last(F.col("_p"), lambda p: (prompt(p) > 0) | (output(p) > 0)))
    u = F.col("_u")
    cached = F.greatest(_number(u, "$.usage.prompt_tokens_details.cached_tokens"), _number(u, "$.usage.input_tokens_details.cached_tokens"))
    model = _first_text(F.col("_p"), "$.model")
    return _done(d, model, F.greatest(prompt(u) - cached, F.lit(0)), F.lit(0), cached, output(u), model.isNotNull() & u.isNotNull())


def provider_three(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Thinking tokens count as output; the last counters that aren't empty count."""
    d = bodies.withColumn("_p", _payloads(F.col(body)))
    m = "$.usageMetadata."
    d = d.withColumn("_u", _last(F.col("_p"), lambda p: (_number(p, m + "promptTokenCount") > 0) | (_number(p, m + "candidatesTokenCount") > 0)))
    u = F.col("_u")
    cached = _number(u, m + "cachedContentTokenCount")
    model = F.coalesce(_first_text(F.col("_p"), "$.modelVersion"), F.lit("gemini"))
    return _done(d, model, F.greatest(_number(u, m + "promptTokenCount") - cached, F.lit(0)), F.lit(0), cached, _number(u, m + "candidatesTokenCount") + _number(u, m + "thoughtsTokenCount"), u.isNotNull())


def _done(d: DataFrame, model: Column, fresh: Column, written: Column, read: Column, out: Column, ok: Column) -> DataFrame:
    columns = {"model": model.cast("string"), "input_tokens": fresh, "cache_creation_tokens": written, "cache_read_tokens": read, "output_tokens": out}
    kept = [c for c in d.columns if not c.startswith("_")]
    return d.select(*kept, *[F.when(ok, v.cast("string" if k == "model" else "bigint")).alias(k) for k, v in columns.items()])
