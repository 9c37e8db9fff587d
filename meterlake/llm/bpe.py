"""Operator 1, BPE encoding and decoding: reuse of content-defined chunks.

A gear rolling hash over 32 bytes cuts texts into chunks wherever its low bits are zero, so equal
passages are cut alike in every document.  Chunks that occur more than once in the corpus (by
128-bit hash and length) are encoded once, by one task, and their ids are joined to each
occurrence.  A chunk's ids are wrong only near its ends, where its neighbours would have joined
its tokens; there the join is repaired: the stretch from the last border of the left chunk's
tokens to the first of the right one's at which no pre-token can reach over (`units`) is
re-encoded, moving outwards until a border agrees with the chunk's own token borders exactly.  A
chunk without two such borders is re-encoded whole.

Moves: chunk hashes, ids of shared chunks, and the texts once by document (compressed, one
exchange read by both the encoding of shared chunks and the final pass).

The ids equal the tokenizers library's for the whole text, special tokens in it included; decoding
joins the tokens' bytes.  Defined results: null text is empty and has no ids; an empty table gives no
rows; copies get equal ids; rows with a null key are encoded whole where they are read; rows
repeated under one key each get their ids, those of unequal texts too; further columns are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from . import units

#: Chunks of 2 KB on average, 256 bytes at least.
MASK, LEAST = 2047, 256
#: Bytes of text, and of ids, worked on together: the hashes take some 50 bytes of memory for each.
TOGETHER = 1 << 20
_GEAR = np.random.default_rng(99).integers(0, 2**32, 256, np.uint32)


def chunk_borders(data: np.ndarray) -> np.ndarray:
    """Borders of the content-defined chunks of one text, its ends included; never inside a character."""
    n = len(data)
    if n <= LEAST:
        return np.array([0, n]) if n else np.array([0])
    h = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):  # after these, h[i] sums gear[data[i - k]] << k for k below 32
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    # the hash's high bits depend on all 32 bytes
    cand = np.flatnonzero(((h >> np.uint32(21)) & np.uint32(MASK)) == 0) + 1
    cand = cand[(cand < n)]
    cand = cand[(data[cand] & 0xC0) != 0x80]
    out, last = [0], 0
    for c in cand.tolist():
        if c - last >= LEAST and n - c >= LEAST:
            out.append(c)
            last = c
    return np.array([*out, n])


def chunks(texts: DataFrame) -> DataFrame:
    """(h1, h2, size, doc, mark, start) of every chunk, from (doc, mark, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.blocks(batches):
            data, offsets = tk.buffer(b.column("text"))
            docs, marks = b.column("doc").to_numpy(), b.column("mark").to_numpy()
            start, size, owner = [], [], []
            for i in range(b.num_rows):
                borders = chunk_borders(data[offsets[i] : offsets[i + 1]])
                start.append(borders[:-1])
                size.append(np.diff(borders))
                owner.append(np.full(len(borders) - 1, i))
            start, size, owner = map(np.concatenate, (start, size, owner))
            at = start + offsets[owner]
            w = tk.Words(data, offsets, at, at + size, offsets)
            yield pa.RecordBatch.from_arrays(
                [*(tk.signed(tk.word_hashes(w, k)) for k in (0, 1)), pa.array(size, pa.int64()), pa.array(docs[owner], pa.int64()), pa.array(marks[owner], pa.int64()), pa.array(start, pa.int64())],
                ["h1", "h2", "size", "doc", "mark", "start"],
            )

    return texts.mapInArrow(run, "h1 long, h2 long, size long, doc long, mark long, start long")


def packed(texts: DataFrame) -> DataFrame:
    """(doc, mark, z): texts compressed, for the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = [c.compress((t or "").encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("mark"), pa.array(z, pa.binary())], ["doc", "mark", "z"])

    return texts.mapInArrow(run, "doc long, mark long, z binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """z becomes text (without key it was not moved, nor compressed); batches are cut by compressed size first
    and by size then, so that they stay small."""
    d = zstandard.ZstdDecompressor()
    for b in tk.blocks(batches, "z", TOGETHER // 4):
        texts = pa.array([(z if doc is None else d.decompress(z)).decode() for doc, z in zip(b.column("doc").to_pylist(), b.column("z").to_pylist(), strict=True)], pa.large_string())
        yield from tk.blocks(iter([b.drop_columns(["z"]).append_column("text", texts)]), "text", TOGETHER)


def _encode_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = units.encoder(path)
        for b in _unpacked(batches):
            pieces, keys = [], []
            for text, parts in zip(b.column("text").to_pylist(), b.column("parts").to_pylist(), strict=True):
                raw = text.encode()
                for p in parts:
                    pieces.append(raw[p["start"] : p["start"] + p["size"]])
                    keys.append((p["h1"], p["h2"], p["size"]))
            data, offsets = np.frombuffer(b"".join(pieces), np.uint8), np.concatenate(([0], np.cumsum([*map(len, pieces)]))).astype(np.int64)
            start, end = units.byte_level_units(data, offsets)
            ids, borders = e.encode(data, start, end)
            cut = borders[np.searchsorted(start, offsets)]
            values = [ids[cut[i] : cut[i + 1]].astype("<u2").tobytes() if ids.max(initial=0) < 65536 else ids[cut[i] : cut[i + 1]].astype("<u4").tobytes() for i in range(len(pieces))]
            wide = [ids.max(initial=0) >= 65536] * len(pieces)
            h1, h2, size = zip(*keys, strict=True) if keys else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(size, pa.int64()), pa.array(values, pa.binary()), pa.array(wide, pa.bool_())],
                ["h1", "h2", "size", "ids", "wide"],
            )

    return run


def _assemble(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, size_of = units.encoder(path), token_table(path)[1]
        for b in units.gathered(_unpacked(batches), limit=TOGETHER):
            data, offsets = tk.buffer(b.column("text"))
            start, end = units.byte_level_units(data, offsets)
            first = np.searchsorted(start, offsets)
            local = np.ones(len(start), bool)
            kept: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in range(b.num_rows)]
            for i, parts in enumerate(b.column("parts").to_pylist()):
                for p in sorted(parts or (), key=lambda p: p["start"]):
                    ids = np.frombuffer(p["ids"], "<u4" if p["wide"] else "<u2").astype(np.uint32)
                    lo, hi = offsets[i] + p["start"], offsets[i] + p["start"] + p["size"]
                    got = _agreed(ids, size_of, start, lo, hi, offsets[i], offsets[i + 1])
                    if got:
                        kept[i].append(got)
                        local[got[0] : got[1]] = False
            ids, cuts = e.encode(data, start[local], end[local])
            place = np.concatenate(([0], np.cumsum(local)))  # a unit's place among those encoded here
            out = []
            for i in range(b.num_rows):
                at, parts = first[i], []
                for a, z, own in kept[i]:
                    parts += [ids[cuts[place[at]] : cuts[place[a]]], own]
                    at = z
                parts.append(ids[cuts[place[at]] : cuts[place[first[i + 1]]]])
                out.append((np.concatenate(parts) if len(parts) > 1 else parts[0]).astype("<u4").tobytes())
            done = pa.RecordBatch.from_arrays([b.column("doc"), pa.array(out, pa.binary())], ["doc", "ids"])
            yield done.append_column("text", _texts(done, path)) if decoded else done

    return run


def _agreed(ids, size_of, start, lo, hi, begin, stop) -> tuple[int, int, np.ndarray] | None:
    """The units from the first to the last border at which the chunk's tokens and the text's units
    agree, and the chunk's ids between; two bytes from the chunk's ends, what stands beyond is not seen."""
    ends = lo + np.concatenate(([0], np.cumsum(size_of[ids])))
    a = np.searchsorted(start, lo if lo == begin else lo + 2)
    z = np.searchsorted(start, hi - 2, "right") - 1 if hi < stop else np.searchsorted(start, hi)
    border = lambda u: start[u] if u < len(start) and start[u] < stop else stop

    def token(u: int) -> int:
        k = np.searchsorted(ends, border(u))
        return int(k) if k < len(ends) and ends[k] == border(u) else -1

    while a < z and token(a) < 0:
        a += 1
    while a < z and token(z) < 0:
        z -= 1
    return (int(a), int(z), ids[token(a) : token(z)]) if a < z else None


def encode(docs: DataFrame, tokenizer_file: str, text: str = "text", key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(key, ids): each text's ids as little-endian unsigned 32-bit numbers.  ``decoded``: and the
    text that these ids stand for, as `decode` gives it, by the same worker."""
    spark = docs.sparkSession
    # the mark tells texts of one key apart
    every = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.col(text).alias("text"))
    given, unnamed = every.filter("doc is not null"), every.filter("doc is null")
    found = chunks(given)
    # one occurrence of each chunk that has several encodes it for all
    shared = found.groupBy("h1", "h2", "size").agg(F.count("*").alias("n"), F.min(F.struct("doc", "mark", "start")).alias("owner")).filter("n > 1")
    todo = shared.select("owner.doc", "owner.mark", F.struct("h1", "h2", "size", F.col("owner.start").alias("start")).alias("p"))
    todo = todo.groupBy("doc", "mark").agg(F.collect_set("p").alias("parts"))
    # the filter is the inner join's own: stated for both joins, so that they read one exchange
    texts = packed(given).filter("doc is not null and mark is not null").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc", "mark")
    coded = texts.join(todo, ["doc", "mark"]).mapInArrow(_encode_chunks(tokenizer_file), "h1 long, h2 long, size long, ids binary, wide boolean")
    each = found.join(coded, ["h1", "h2", "size"]).groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "size", "ids", "wide")).alias("parts"))
    both = texts.join(each, ["doc", "mark"], "left").select("doc", "z", "parts").unionByName(unnamed.select("doc", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("z")), allowMissingColumns=True)
    return both.mapInArrow(_assemble(tokenizer_file, decoded), "doc long, ids binary" + ", text string" * decoded).withColumnRenamed("doc", key)


@lru_cache(4)
def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens end to end, each token's number of bytes, and its place."""
    spec = json.load(open(path))
    # byte-level vocabularies write each byte as a printable character: itself where it is one, else from U+0100 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    tokens = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in byte_of for c in t)}
    tokens |= {a["id"]: a["content"].encode() for a in spec["added_tokens"]}
    rows = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    size = np.array([*map(len, rows)])
    return np.frombuffer(b"".join(rows), np.uint8), size, np.concatenate(([0], np.cumsum(size)))[:-1]


def _texts(coded: pa.RecordBatch, path: str) -> pa.Array:
    """The texts that a batch's ids stand for."""
    flat, size, place = token_table(path)
    out = []
    for raw in coded.column("ids").to_pylist():
        ids = np.frombuffer(raw, "<u4")
        n = size[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ids) else 0
        at = np.arange(total) + np.repeat(place[ids] - (ends - n), n)
        out.append(flat[at].tobytes().decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def decode(coded: DataFrame, tokenizer_file: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, text) from (key, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.blocks(batches, "ids", TOGETHER):
            yield b.append_column("text", _texts(b, tokenizer_file))

    kind = coded.schema[key].dataType.simpleString()
    return coded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, ids binary, text string")
