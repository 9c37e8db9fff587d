"""Operator 10, substring dedup: difference-cover anchors.

A set of residues modulo `PERIOD` is a difference cover when every difference modulo the period is one
of two of its members.  Then for any two positions there is a shift below the period after which
both lie on cover positions, so two equal runs of `WINDOW` words share an aligned anchor of
`WINDOW - PERIOD + 1` words that starts at a cover position of each text.  Only anchors at cover
positions are hashed and shuffled: |cover| in PERIOD of all positions.

Anchors that stand in two different texts are extended: windows of `WINDOW` words that hold such an
anchor are hashed (96 bits), and a window whose words also start in a text of a smaller id is
removed.  Whole-text copies are one class; only the smallest of a class is anchored.

What decides are how often an anchor stands, and the least document of a window.  Both are found where the rows of
a key meet, so anchors and windows move once each.  Keys of more than one in `HOT` of the rows are told beforehand by
Spark's sketch of frequent items, `HOT` at most: their rows are dealt over many tasks, and a passage in a third of all
texts gathers nowhere.  (An anchor that one text alone repeats is extended in vain; windows decide.)  Texts are
shuffled once, by document; anchor generation, extension and the final cutting read that same exchange.
What moves besides are anchors and windows, as numbers.

Defined results: null text has no words; texts below `WINDOW` words lose nothing; repeats within one
text alone lose nothing; the smallest document keeps its copy; rows repeated under one id are alike
and lose alike; rows with a null id have no place in the order: they lose nothing and cause no loss; an
empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import cut

WINDOW, PERIOD = 50, 31
#: A perfect difference set: each non-zero residue is one difference of two members.
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
#: Bits of an anchor's hash.  Anchors only nominate windows, so an accidental meeting costs an extension and no word;
#: shorter hashes make both exchanges of anchors smaller.
ANCHOR_BITS = 48
#: A key is hot that makes up more than one in `HOT` of the rows; the rows of hot keys are dealt over `SALTS` parts.
HOT, SALTS = 4096, 64
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _positions(w: tk.Words) -> np.ndarray:
    """Place of each word in its text."""
    return np.arange(len(w.start)) - np.repeat(w.first[:-1], w.count)


def sequences(docs: DataFrame) -> DataFrame:
    """(doc, n, s1, s2): word count and a 128-bit hash of each text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.blocks(batches):
            w = tk.words(b.column("text"))
            sums = [tk.signed(tk.sequence_hashes(w, tk.word_hashes(w, k), k)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(w.count), *sums], ["doc", "n", "s1", "s2"])

    return docs.mapInArrow(run, "doc long, n long, s1 long, s2 long")


def anchors(texts: DataFrame) -> DataFrame:
    """(h, doc, at): hashes of the anchors at cover positions, from (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.blocks(batches):
            w = tk.words(b.column("text"))
            at = _positions(w)
            pick = np.flatnonzero((w.left() >= ANCHOR) & _IN_COVER[at % PERIOD] & (np.repeat(w.count, w.count) >= WINDOW))
            h = tk.window_hashes(tk.word_hashes(w), ANCHOR)[pick] if len(pick) else np.zeros(0, np.uint64)
            h = h >> np.uint64(64 - ANCHOR_BITS)
            doc = b.column("doc").to_numpy()[w.text_of()[pick]]
            yield pa.RecordBatch.from_arrays([tk.signed(h), pa.array(doc, pa.int64()), pa.array(at[pick], pa.int32())], ["h", "doc", "at"])

    return texts.mapInArrow(run, "h long, doc long, at int")


def windows(texts: DataFrame) -> DataFrame:
    """(h1, h2, doc, at): windows that hold a shared anchor, from (doc, text, places of anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.blocks(batches):
            w = tk.words(b.column("text"))
            places = b.column("places")
            anchor = w.first[np.repeat(np.arange(b.num_rows), places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
            anchor = anchor + places.flatten().to_numpy(zero_copy_only=False)
            anchor = anchor[anchor < len(w.start)]
            n = len(w.start)
            mark = np.zeros(n + 1, np.int64)
            text = w.text_of()
            low = np.maximum(anchor - (WINDOW - ANCHOR), w.first[:-1][text[anchor]]) if len(anchor) else anchor
            np.add.at(mark, low, 1)
            np.add.at(mark, anchor + 1, -1)
            pick = np.flatnonzero((np.cumsum(mark)[:n] > 0) & (w.left() >= WINDOW))
            h = [tk.window_hashes(tk.word_hashes(w, k), WINDOW, k)[pick] if len(pick) else np.zeros(0, np.uint64) for k in (0, 1)]
            half = pa.array((h[1] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            doc = b.column("doc").to_numpy()[text[pick]]
            at = _positions(w)[pick]
            yield pa.RecordBatch.from_arrays([tk.signed(h[0]), half, pa.array(doc, pa.int64()), pa.array(at, pa.int32())], ["h1", "h2", "doc", "at"])

    return texts.mapInArrow(run, "h1 long, h2 int, doc long, at int")


def frequent(rows: DataFrame, key: str) -> DataFrame:
    """(key,): `HOT` values of ``key`` at most, by Spark's sketch of frequent items; all that make up more than one
    in `HOT` of the rows are among them, so a broadcast of them is bounded."""
    return rows.freqItems([key], 1 / HOT).select(F.explode(f"{key}_freqItems").alias(key))


def shared_anchors(every: DataFrame) -> DataFrame:
    """(doc, at) of the anchors (h, doc, at) that stand more than once.  Frequent ones are dealt over `SALTS` parts by document
    and taken as shared."""
    hot = F.broadcast(frequent(every, "h").withColumn("hot", F.lit(True)))
    dealt = every.join(hot, "h", "left").select("h", "doc", "at", _salt(F.col("hot")))
    times = F.count("*").over(Window.partitionBy("h", "salt"))
    return dealt.withColumn("times", times).filter("salt is not null or times > 1").select("doc", "at")


def repeated_windows(held: DataFrame) -> DataFrame:
    """(doc, at) of the windows (h1, h2, doc, at) that stand in a smaller document too.  The least document of a frequent window
    is an aggregate with partial results; its rows are dealt over `SALTS` parts by document."""
    hot = held.join(F.broadcast(frequent(held, "h1")), "h1").groupBy("h1", "h2").agg(F.min("doc").alias("lo"))
    dealt = held.join(F.broadcast(hot), ["h1", "h2"], "left").filter("lo is null or lo < doc")
    dealt = dealt.select("h1", "h2", "doc", "at", _salt(F.col("lo").isNotNull()))
    lo = F.min("doc").over(Window.partitionBy("h1", "h2", "salt"))
    return dealt.withColumn("lo", lo).filter("salt is not null or lo < doc").select("doc", "at")


def _salt(hot: Column) -> Column:
    return F.when(hot, F.pmod(F.xxhash64("doc"), F.lit(SALTS))).cast("int").alias("salt")


def _covered(n: int, places: np.ndarray) -> np.ndarray:
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, places, 1)
    np.add.at(mark, places + WINDOW, -1)
    return np.cumsum(mark)[:n] > 0


def trimmed(texts: DataFrame) -> DataFrame:
    """(doc, n_words, n_removed, kept): ``kept`` has the words left, from (doc, text, places of removed windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.blocks(batches):
            rows = []
            for text, places in zip(b.column("text").to_pylist(), b.column("places").to_pylist(), strict=True):
                # bytes split at space and \x09-\x0D, as the words are defined; str would split at more
                found = (text or "").encode().split()
                n, gone = len(found), 0
                if places:
                    cover = _covered(n, np.asarray([p for p in places if p + WINDOW <= n], np.int64))
                    gone = int(cover.sum())
                    found = [x for x, c in zip(found, cover, strict=True) if not c]
                rows.append((n, gone, b" ".join(found)))
            n, gone, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc", "n_words", "n_removed", "kept"])

    return texts.mapInArrow(run, "doc long, n_words long, n_removed long, kept string")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, kept) of every document."""
    spark = docs.sparkSession
    every = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    given, unnamed = every.filter("doc is not null"), every.filter("doc is null")
    seq = cut(sequences(given), "sequences")
    smallest = seq.groupBy("s1", "s2", "n").agg(F.min("doc").alias("rep"))
    copies = seq.join(smallest, ["s1", "s2", "n"]).filter(f"doc <> rep and n >= {WINDOW}").select("doc")
    # copies of a whole text of a window or more: every word goes, and the smallest stands for them all
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = given.repartition(parts, "doc").join(copies, "doc", "left_anti")

    places = shared_anchors(anchors(own)).groupBy("doc").agg(F.collect_list("at").alias("places"))
    held = windows(own.join(places, "doc"))
    gone = repeated_windows(held).groupBy("doc").agg(F.collect_list("at").alias("places"))
    kept = trimmed(own.join(gone, "doc", "left").select("doc", "text", "places"))
    whole = seq.join(copies, "doc", "left_semi").select("doc", F.col("n").alias("n_words"), F.col("n").alias("n_removed"), F.lit("").alias("kept"))
    apart = trimmed(unnamed.select("doc", "text", F.lit(None).cast("array<int>").alias("places")))
    return kept.unionByName(whole).unionByName(apart).withColumnRenamed("doc", key)


def digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()
