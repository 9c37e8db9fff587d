"""Operator 3, license scans: an exact set-similarity join of text blocks with license templates.

Blocks are lines of up to twice the longest template's length and, over line breaks and longer lines, windows of that
many words that overlap by half, so that wording stands in one block however its lines are wrapped, and words that stand far apart don't.  A block matches a template when it
holds at least `CONTAINMENT` of the template's distinct words.  The words of all templates are ordered by their
frequency in the whole corpus, rarest first, and both sides are written in that order (a block without the words
of no template, which can't be shared).  With need = ceil(c |T|), a matching block shares a word among the first
|T| - need + 1 of the template and the first |B| - need + 1 of its own (prefix filter), has `need` words (length
filter), and where a word stands at places i and j of the two, min(i, j) + 1 + min(|T| - i, |B| - j) - 1 is at
least need (positional filter).  Survivors are verified exactly.  The template table is a constant of a few
rows, so its side of the join is broadcast; the corpus is never shuffled, only hits are.

Only DataFrame functions are used.  Defined results: null text is empty; a text without words has
no labels and score 0; repeated words count once in a block; ties in frequency go by the word;
rows with a null id, or one id with several texts, each get the result of their own text; an empty table gives
no rows; further columns of the input are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base rule: phrase and label.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Templates of the method: label and wording.
TEMPLATES = [
    ("mit", "released under the terms of the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
CONTAINMENT = 0.8

WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text."""
    bare = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), BREAK, " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def _any_word(tokens: list[str]) -> str:
    """A regular expression for a text that has one of these words, in any case of A-Z."""
    return f"(?i)(?<!{WORD})(?:{'|'.join(sorted(tokens))})(?!{WORD})"


def frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """How often each word of the template vocabulary stands in the corpus (one row a word)."""
    found = (
        docs.select(F.explode(F.split(F.lower(text), BREAK)).alias("w")).filter(F.col("w").isin(vocabulary)).groupBy("w").count()
    )
    return {r["w"]: r["count"] for r in found.collect()}  # at most as many rows as the vocabulary has words


def global_order(vocabulary: list[str], freq: dict[str, int]) -> list[str]:
    """The templates' words, rarest in the corpus first; ties by the word."""
    return sorted(vocabulary, key=lambda w: (freq.get(w, 0), w))


def prefix_index(order: list[str], templates=TEMPLATES, containment: float = CONTAINMENT) -> list[tuple]:
    """(word, template, label, ordered words, need, place of the word): the prefixes' entries."""
    rank, rows = {w: i for i, w in enumerate(order)}, []
    for k, (label, wording) in enumerate(templates):
        tokens = sorted(set(wording.split()), key=rank.__getitem__)
        need = math.ceil(containment * len(tokens) - 1e-9)
        rows += [(w, k, label, tokens, need, i) for i, w in enumerate(tokens[: len(tokens) - need + 1])]
    return rows


def matches(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, mark, block, label, score): every block and template with containment at least the threshold;
    ``mark`` tells texts of one key apart."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    order = global_order(vocabulary, frequencies(docs, vocabulary, text))
    index = prefix_index(order, templates, containment)
    # a constant table: as many rows as the templates' prefixes have words
    names = ["token", "template", "label", "tokens", "need", "i"]
    entries = spark.range(1).select(F.inline(F.array(*[F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in index])))
    prefix, least = sorted({r[0] for r in index}), min(r[4] for r in index)
    longest = max(len(t.split()) for _, t in templates)
    given = docs.filter(F.col(text).rlike(_any_word(prefix)))
    given = given.select(F.col(key).alias("key"), _mark(F.col(text)).alias("mark"), F.transform(F.split(text, "\n"), words).alias("lines"))
    wide = lambda w: F.size(w) > 2 * longest
    given = given.withColumn("w", F.when((F.size("lines") > 1) | F.exists("lines", wide), F.flatten("lines")).otherwise(F.array().cast("array<string>")))
    windows = F.transform(F.sequence(F.lit(0), F.size("w"), F.lit(longest)), lambda i: F.slice("w", i + 1, F.lit(2 * longest)))
    blocks = (
        given.select("key", "mark", F.posexplode(F.concat(F.filter("lines", lambda w: ~wide(w)), windows)).alias("block", "w"))
        .filter(F.arrays_overlap("w", F.array(*map(F.lit, prefix))))
        .select("key", "mark", "block", F.array_intersect(F.array(*map(F.lit, order)), "w").alias("b"))  # in the order of the first
        .filter(F.size("b") >= least)
    )
    i, j, t, b, need = F.col("i"), F.col("j"), F.size("tokens"), F.size("b"), F.col("need")
    met = (
        blocks.select("*", F.posexplode(F.slice("b", F.lit(1), b - least + 1)).alias("j", "token"))
        .join(F.broadcast(entries), "token")
        .filter((b >= need) & (j <= b - need))  # length, and the block's own prefix
        .filter(F.least(i, j) + F.least(t - i, b - j) >= need)  # position
        .withColumn("shared", F.size(F.array_intersect("b", "tokens")))
        .filter(F.col("shared") >= need)
    )
    return met.groupBy("key", "mark", "block", "label").agg(F.max(F.col("shared") / t).alias("score")).withColumnRenamed("key", key)


def _mark(text: Column) -> Column:
    """Tells the texts of one key apart."""
    return F.when(text.isNotNull(), F.sha2(text, 256))


def phrases(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The base rule: where a phrase's words stand consecutively."""
    t = F.coalesce(F.col(text), F.lit(""))
    # a superset of the texts with a phrase; the others need no word list
    may = F.lower(t).contains("license") | t.rlike(rf"(?i)(?<!{WORD})cc{GAP}by")
    d = docs.select(
        F.col(key), _mark(F.col(text)).alias("mark"), F.regexp_count(t, F.lit(f"{WORD}+")).cast("long").alias("n_words"),
        F.when(may, words(t)).otherwise(F.array().cast("array<string>")).alias("w"),
    )

    def places(phrase: str) -> Column:
        p = phrase.split()
        at = F.sequence(F.lit(0), F.size("w") - len(p))
        same = F.filter(at, lambda i: F.slice("w", i + 1, len(p)) == F.array(*map(F.lit, p)))
        return F.when((F.size("w") >= len(p)) & F.array_contains("w", p[0]), same).otherwise(F.array().cast("array<int>"))

    d = d.select(key, "mark", "n_words", F.array(*[places(p) for p, _ in PHRASES]).alias("at"))
    every = F.flatten("at")
    return d.select(
        key, "mark", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(F.element_at("at", k + 1)) > 0, F.lit(name)) for k, (_, name) in enumerate(PHRASES)])).alias("base"),
    )


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: counts and places of the base phrases, labels of both ways, score."""
    found = matches(docs, text=text, key=key).groupBy(key, "mark").agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    d, found = phrases(docs, text, key), found.withColumnRenamed(key, "found_key").withColumnRenamed("mark", "found_mark")
    d = d.join(found, F.col(key).eqNullSafe(F.col("found_key")) & (F.col("mark") == F.col("found_mark")), "left")
    both = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return d.select(
        key, "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
