"""Operator 4, best-fit packing by sums of squares.

N(g) is the number of open sequences with g tokens left.  A piece goes where the sum of N(g)^2
becomes smallest: into an open sequence or a new one, ties to the smallest rest.  Keeping the
counts of residual gaps small leaves few sequences that nothing fits.

Texts are encoded in the tasks that read them; from then on only pieces (ids, no text) move.
Pieces are packed in shards of about `SHARD` pieces, longest first; the sequences left open are then
packed as units, in groups that join up to `FAN` shards but hold about `SHARD` units, and so on until
one group is left or a level joins less than one in `LEAST` of its units (where most pieces are over half
a sequence, open ones don't fit together).  So no task sees more than about a shard, each its own partition.

Defined results: null text is empty and becomes one piece, the end token; pieces of a text longer
than a sequence are full but for the last; equal texts are packed one by one; an empty table
gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from . import units
from .common import cut

LENGTH, END = 2048, 0
SHARD, FAN, LEAST = 40_000, 64, 100


def pieces(docs: DataFrame, tokenizer_file: str, text: str = "text", key: str = "doc_id", length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc, piece, start, length, ids_crc32): texts encoded, ended and cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = units.encoder(tokenizer_file)
        for b in units.gathered(batches):
            data, offsets = tk.buffer(b.column("text"))
            if b"<|" not in (raw := data.tobytes()):  # else special tokens may stand there, in their own case
                data = np.frombuffer(raw.lower(), np.uint8)  # A-Z only, as the tokenizer does anyway: fewer distinct units
            start, stop = units.spaced_units(data, offsets)
            ids, borders = e.encode(data, start, stop)
            at = borders[np.searchsorted(start, offsets)]
            rows = []
            for i, doc in enumerate(b.column("doc").to_pylist()):
                own = np.append(ids[at[i] : at[i + 1]], np.uint32(end)).astype("<u4")
                for k, s in enumerate(range(0, len(own), length)):
                    part = own[s : s + length]
                    rows.append((doc, k, s, len(part), zlib.crc32(part.tobytes())))
            cols = zip(*rows, strict=True)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc", "piece", "start", "length", "ids_crc32"])

    given = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    return given.mapInArrow(run, "doc long, piece int, start long, length long, ids_crc32 long")


def place(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces in this order: each one's bin and offset, and each bin's fill."""
    n = np.zeros(length + 1, np.int64)
    by_gap: list[list[int]] = [[] for _ in range(length + 1)]
    bins, offsets, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    never = np.iinfo(np.int64).max
    for i, w in enumerate(sizes.tolist()):
        open_ = n[w:]  # open_[r]: bins in which r is left after this piece
        if w < length and open_.any():
            change = 2 * (n[: len(open_)] - open_) + 2
            change[0] = 1 - 2 * open_[0]  # a full bin isn't counted
            change[open_ == 0] = never
            r = int(change.argmin())
            best = change[r]
        else:
            best = never
        if best <= 2 * n[length - w] + 1 and best != never:
            b = by_gap[w + r].pop()
            n[w + r] -= 1
            rest = r
        else:
            b, rest = len(fill), length - w
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += w
        if rest:
            n[rest] += 1
            by_gap[rest].append(b)
    return bins, offsets, np.array(fill, np.int64)


def _pack(given: DataFrame, length: int, groups: int) -> DataFrame:
    """(item, bin, off, fill) from (item, size): each of the groups packed by itself."""
    given = given.withColumn("group", F.pmod(F.xxhash64("item", F.lit(groups)), F.lit(groups))).repartition(groups, "group")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", "item"], ascending=[False, True], ignore_index=True)
        bins, offsets, fill = place(g["size"].to_numpy(), length)
        # a bin is named by its first item: unique everywhere, and the same when a task runs again
        first = g["item"].to_numpy()[np.unique(bins, return_index=True)[1]]
        return pd.DataFrame({"item": g["item"], "bin": first[bins], "off": offsets, "fill": fill[bins]})

    return given.groupBy("group").applyInPandas(run, "item long, bin long, off long, fill long")


def _units(at: DataFrame, length: int) -> int:
    """Sequences that are still open."""
    return at.filter(F.col("fill") < length).select("bin").distinct().count()


def pack(docs: DataFrame, tokenizer_file: str, text: str = "text", key: str = "doc_id", length: int = LENGTH, end: int = END) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset): one row a piece."""
    made = pieces(docs, tokenizer_file, text, key, length, end)
    made = cut(made.withColumn("item", F.monotonically_increasing_id()), "pieces")
    part = made.filter(F.col("length") < length).select("item", F.col("length").alias("size"))
    groups = max(1, -(-part.count() // SHARD))
    at = cut(_pack(part, length, groups), "packed")
    units = _units(at, length) if groups > 1 else 0
    while groups > 1:
        before, groups = units, max(-(-groups // FAN), -(-units // SHARD))
        open_ = at.filter(F.col("fill") < length).groupBy("bin").agg(F.first("fill").alias("size"))
        again = _pack(open_.select(F.col("bin").alias("item"), "size"), length, max(groups, 1))
        again = again.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("off").alias("shift"), F.col("fill").alias("filled"))
        at = at.join(again, "bin", "left").select(
            "item", F.coalesce("to", "bin").alias("bin"), (F.col("off") + F.coalesce("shift", F.lit(0))).alias("off"), F.coalesce("filled", "fill").alias("fill")
        )
        at = cut(at, "packed")
        units = _units(at, length)
        if (before - units) * LEAST < before:
            break
    full = made.filter(F.col("length") == length).select("*", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = made.join(at.select("item", F.col("bin").alias("sequence_id"), F.col("off").alias("offset")), "item").select(*full.columns)
    return full.unionByName(rest).drop("item").withColumnRenamed("doc", key)
