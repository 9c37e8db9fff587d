"""Operator 7, quality rules: a threshold table compiled into one Spark projection.

Each rule is a ratio of two measures with bounds.  All measures are built-in functions over one
text, so the plan is one scan without shuffle and without user functions.

Defined results: a null text has no words and no lines; a text without words fails (fewer than 20
words); ratios with a zero denominator pass; repeated rows are judged alike, each by itself; an
empty table gives no rows; columns of the input with any name survive `keep`, which carries the
row as one struct.  Windows of eight words are compared by 64-bit hashes of their words' hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base measures.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30

#: Common words of the corpus's languages, lower case.
STOP_WORDS = (
    "the of and to in that is was for on with by this are as at from it or be "
    "de la le et les des en un une du que qui est dans pour au ce il elle "
    "der die und den das ist ein eine von zu mit im auf für sich nicht "
    "el los las y del por con una se no lo su al como"
).split()

#: (rule, numerator, denominator, least, most, from this many words on); None: no bound.
RULES = [
    ("mean word length", "word_chars", "n_words", 2.0, 12.0, 1),
    ("symbols to words", "n_symbols", "n_words", None, 0.1, 1),
    ("exclamation marks to words", "n_marks", "n_words", None, 0.5, 1),
    ("stop words to words", "n_stop", "n_words", 0.01, None, 50),
    ("duplicate lines to lines", "n_dup_lines", "n_lines", None, 0.4, 1),
]


def verdict(rules=RULES) -> Column:
    """The table as one boolean expression."""
    passed = F.lit(True)
    for _, top, below, least, most, from_words in rules:
        ratio = F.col(top) / F.when(F.col(below) > 0, F.col(below))
        bad = F.lit(False)
        if least is not None:
            bad = bad | (ratio < least)
        if most is not None:
            bad = bad | (ratio > most)
        passed = passed & ~((F.col("n_words") >= from_words) & F.coalesce(bad, F.lit(False)))
    return passed


def _chars(text: Column, drop: str) -> Column:
    """Characters of ``text`` that are among ``drop``."""
    return (F.length(text) - F.length(F.translate(text, drop, ""))).cast("long")


def measure(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``row`` (the input row) beside its measures, ``base_failed`` and ``kept``."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    d = d.select("row", F.coalesce(F.col(f"row.`{text}`"), F.lit("")).alias("t"))
    bare = F.trim("t", F.lit(SPACES))
    d = d.select(
        "row", "t", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")).alias("w")
    )
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = [F.xxhash64(F.lit(x)) for w in STOP_WORDS for x in dict.fromkeys((w, w.capitalize()))]
    d = d.select(
        "row", "t", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"), lines.alias("l")
    )
    # h is read several times on purpose: an array read once inside a lambda would be built anew for each element
    windows = F.when(F.size("h") < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("h", i, WINDOW)))
    )
    d = d.select(
        "row", "t", "n", F.size(F.filter("h", lambda x: x.isin(stop))).alias("s"), windows.alias("g"),
        F.size("l").alias("nl"), (F.size("l") - F.size(F.array_distinct("l"))).alias("dl"),
    )
    entry = "array<struct<h:bigint,i:int>>"
    d = d.select(
        *["row", "t", "n", "s", "nl", "dl"],
        F.when(
            F.size(F.array_distinct("g")) < F.size("g"),
            F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i")))),
        ).otherwise(F.array().cast(entry)).alias("o"),
    )
    pairs = F.zip_with(
        "o", F.slice("o", 2, F.greatest(F.size("o"), F.lit(1))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    d = d.select(*["row", "t", "n", "s", "nl", "dl"], F.sort_array(F.array_distinct(F.flatten(pairs))).alias("p"))
    steps = F.zip_with(
        "p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))
    )
    d = d.select(
        "row",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        _chars(F.col("t"), SYMBOLS).alias("n_symbols"),
        _chars(F.col("t"), "!").alias("n_marks"),
        F.col("s").cast("long").alias("n_stop"),
        F.col("nl").cast("long").alias("n_lines"),
        F.col("dl").cast("long").alias("n_dup_lines"),
        F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    d = d.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    # a generator of one row: a filter above would else be pushed down, and the whole projection with it, once a measure
    out = [c for c in d.columns if c != "row"]
    return d.select("row", F.inline(F.array(F.struct(*out))))


def keep(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they were."""
    return measure(docs, text, rules).filter("kept").select("row.*")
