"""Cache markers of request bodies: whether there are any, what they would save, and bodies with them.

A variant's JSON text is canonical, and quotes inside its strings are escaped, so a key stands in it exactly where
its quoted name follows a brace or a comma and precedes a colon, at any depth.

Defined results: a body that is null or no JSON saves nothing and stays as it is; so does one with a marker anywhere, or
without anything to mark; lists within lists of blocks are followed three deep; rewritten bodies have sorted keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.plans.ratecard import nano, resolve

#: The marker, and characters that count as a token.
MARK, CHARS_PER_TOKEN = '"cache_control":{"type":"ephemeral"}', 4


def parsed(body: Column) -> Column:
    return F.try_parse_json(F.regexp_replace(body, r"^\x{FEFF}", ""))


def marked(v: Column) -> Column:
    """Whether a key of that name stands anywhere in a variant."""
    return F.to_json(v).rlike(r'[{,]"cache_control":')


def _kind(v: Column) -> Column:
    return F.substring_index(F.schema_of_variant(v), "<", 1)


def _string(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.variant_get(v, "$", "string"))


def characters(v: Column, depth: int = 3) -> Column:
    """Code points of a text, of the texts of blocks, or of a list of them."""
    block = F.when(_kind(v) == "OBJECT", _string(F.variant_get(v, "$.text", "variant")))
    own = F.coalesce(F.length(_string(v)), F.length(block), F.lit(0))
    if not depth:
        return own
    inner = F.aggregate(F.try_variant_get(v, "$", "array<variant>"), F.lit(0), lambda a, x: a + characters(x, depth - 1))
    return F.when(_kind(v) == "ARRAY", inner).otherwise(own)


def eligible(v: Column) -> Column:
    """Code points of the system prompt and the first message."""
    first = F.get(F.try_variant_get(v, "$.messages", "array<variant>"), F.lit(0))
    part = lambda x: F.coalesce(characters(x), F.lit(0))
    return part(F.try_variant_get(v, "$.system", "variant")) + part(F.try_variant_get(first, "$.content", "variant"))


def foregone(bodies: DataFrame, body: str = "body") -> DataFrame:
    """``bodies`` with ``model``, ``characters`` and ``savings`` (whole billionths of a dollar a call, once the cache is warm)."""
    d = bodies.withColumn("_v", parsed(F.col(body)))
    d = d.withColumn("model", _string(F.variant_get("_v", "$.model", "variant"))).withColumn("characters", F.when(marked(F.col("_v")), 0).otherwise(F.coalesce(eligible(F.col("_v")), F.lit(0))))
    per_token = (F.col("rate_in") - F.col("rate_cr")) / 1e6
    d = resolve(d.drop("_v")).withColumn("savings", F.greatest(nano(F.col("characters") / CHARS_PER_TOKEN * per_token), F.lit(0)))
    return d.drop("rate_in", "rate_cw", "rate_cr", "rate_out")


def _with_mark(block: Column) -> Column:
    text = F.to_json(block)
    return F.concat(F.left(text, F.length(text) - 1), F.when(text == "{}", "").otherwise(","), F.lit(MARK + "}"))


def _mark(v: Column) -> Column:
    """JSON text of a prompt with the marker on its last block; null where there is none to mark."""
    blocks = F.try_variant_get(v, "$", "array<variant>")
    last = F.try_element_at(blocks, F.lit(-1))
    before = F.transform(F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0))), lambda x: F.to_json(x))
    listed = F.concat(F.lit("["), F.array_join(F.concat(before, F.array(_with_mark(last))), ","), F.lit("]"))
    text = F.concat(F.lit('[{"type":"text","text":'), F.to_json(v), F.lit("," + MARK + "}]"))
    return F.when(_kind(v) == "STRING", text).when((_kind(v) == "ARRAY") & (_kind(last) == "OBJECT"), listed)


def _replaced(v: Column, key: str, text: Column) -> Column:
    """JSON text of an object with another value under a key."""
    pairs = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    name = lambda k: F.to_json(F.array(k))
    put = F.transform(pairs, lambda e: F.concat(F.substring(name(e["key"]), F.lit(2), F.length(name(e["key"])) - 2), F.lit(":"), F.when(e["key"] == key, text).otherwise(F.coalesce(F.to_json(e["value"]), F.lit("null")))))
    return F.concat(F.lit("{"), F.array_join(put, ","), F.lit("}"))


def hinted(bodies: DataFrame, body: str = "body") -> DataFrame:
    """``bodies`` with ``hinted``: the body with markers on its system prompt and first message, and ``modified``."""
    d = bodies.withColumn("_v", parsed(F.col(body)))
    d = d.withColumn("_system", _mark(F.try_variant_get("_v", "$.system", "variant"))).withColumn("_turns", F.try_variant_get("_v", "$.messages", "array<variant>"))
    d = d.withColumn("_first", _mark(F.try_variant_get(F.get("_turns", F.lit(0)), "$.content", "variant")))
    d = d.withColumn("modified", F.coalesce(~marked(F.col("_v")) & (F.col("_system").isNotNull() | F.col("_first").isNotNull()), F.lit(False)))
    rest = F.transform(F.slice("_turns", 2, F.greatest(F.size("_turns"), F.lit(1))), lambda x: F.to_json(x))
    turns = F.concat(F.lit("["), F.array_join(F.concat(F.array(_replaced(F.get("_turns", F.lit(0)), "content", F.col("_first"))), rest), ","), F.lit("]"))
    whole = F.when(F.col("_first").isNotNull(), _replaced(F.col("_v"), "messages", turns)).otherwise(F.to_json("_v"))
    whole = F.when(F.col("_system").isNotNull(), _replaced(F.parse_json(whole), "system", F.col("_system"))).otherwise(whole)
    d = d.withColumn("hinted", F.when(F.col("modified"), whole).otherwise(F.col(body)))
    return d.drop("_v", "_system", "_turns", "_first")
