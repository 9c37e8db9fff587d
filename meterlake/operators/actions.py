"""What an agent does in a turn: the signature of its last tool call, and how often it comes back.

A variant keeps an object's keys sorted at every depth, so its JSON text is canonical: bodies that differ in the order of
keys or in blanks have one signature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.operators.windows import in_window

SPAN, THRESHOLD = 300, 10


def canonical(v: Column) -> Column:
    return F.to_json(v)


def _list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _text(v: Column, path: str) -> Column:
    at = F.variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.variant_get(at, "$", "string"))


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def _call(name: Column, args: Column) -> Column:
    return F.struct(F.coalesce(name, F.lit("")).alias("name"), F.coalesce(args, F.lit("")).alias("arguments"))


def last_actions(calls: DataFrame, body: str = "body") -> DataFrame:
    """``calls`` with ``action``: (name, arguments) of the last tool call of the last actor's turn, in any of three shapes; null
    without one.  Each step is a column of its own, so a body is parsed and searched once."""
    role = lambda c: F.variant_get(c, "$.role", "variant")
    is_text = lambda x, path, word: F.coalesce(_text(x, path) == word, F.lit(False))
    d = calls.withColumn("_v", F.try_parse_json(F.regexp_replace(F.col(body), r"^\x{FEFF}", "")))
    d = d.withColumn("_turn", _last(F.filter(_list(F.col("_v"), "$.messages"), lambda m: is_text(m, "$.role", "assistant"))))
    # a turn without role counts as the actor's in the third shape
    d = d.withColumn("_actor", _last(F.filter(_list(F.col("_v"), "$.contents"), lambda c: role(c).isNull() | F.coalesce(_text(c, "$.role") == "model", F.schema_of_variant(role(c)) != "STRING"))))
    d = d.withColumn("_use", _last(F.filter(_list(F.col("_turn"), "$.content"), lambda b: is_text(b, "$.type", "tool_use"))))
    d = d.withColumn("_call", F.variant_get(_last(_list(F.col("_turn"), "$.tool_calls")), "$.function", "variant"))
    d = d.withColumn("_part", F.variant_get(_last(F.filter(_list(F.col("_actor"), "$.parts"), lambda p: F.variant_get(p, "$.functionCall", "variant").isNotNull())), "$.functionCall", "variant"))
    d = d.withColumn("_raw", F.coalesce(_text(F.col("_call"), "$.arguments"), F.lit("")))
    action = (
        F.when(F.col("_use").isNotNull(), _call(_text(F.col("_use"), "$.name"), canonical(F.variant_get("_use", "$.input", "variant"))))
        .when(F.col("_call").isNotNull(), _call(_text(F.col("_call"), "$.name"), F.coalesce(canonical(F.try_parse_json("_raw")), F.col("_raw"))))
        .when(F.col("_part").isNotNull(), _call(_text(F.col("_part"), "$.name"), canonical(F.variant_get("_part", "$.args", "variant"))))
    )
    # a generator of one row: filters above don't make the whole expression again
    return d.select(*(F.col(f"`{c}`") for c in calls.columns), F.explode(F.array(action)).alias("action"))


def signed(calls: DataFrame, body: str = "body") -> DataFrame:
    """``calls`` with the signature of their action; null where there is none."""
    text = F.concat(F.col("action.name"), F.lit("\0"), F.col("action.arguments"))
    return last_actions(calls, body).withColumn("signature", F.sha2(text, 256)).drop("action")


def repeats(calls: DataFrame, *by: str, span_s: int = SPAN, threshold: int = THRESHOLD) -> DataFrame:
    """Calls whose action is seen for the ``threshold``-th time or more within the span; each call counts when it comes."""
    d = in_window(calls.filter("signature is not null"), F.lit(1), span_s, *by, "signature")
    return d.filter(F.col("windowed_n") >= threshold).select("id", *by, "signature", F.col("windowed_n").alias("n"))
