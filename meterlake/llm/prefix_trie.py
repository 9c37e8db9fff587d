"""Operator 13, conversation prefix trie: family-first merging.

A conversation c belongs to the family of its base c - c % 100 and is rebuilt: the base's first h turns (h from
c's checksum, `OPENING` at most), then c's own turns after its first h.  A node is a distinct sequence of first turns.

1. Turns are sorted over all tasks by conversation and order (so a long conversation spreads over tasks),
   hashed, and kept as chunks: a row for up to `chunk` turns, 20 bytes a turn.
2. Chunks are cogrouped with their base's opening by family and stretch of `chunk` turns: at most 100 conversations
   of `chunk` turns.  A group rebuilds its conversations, tells each prefix by the exclusive or of
   128-bit hashes of its turns with their places, and builds the family's small trie.  A conversation that goes on
   in another stretch gets there the hash of all before it, from one row a stretch.
3. Only combined family nodes are shuffled, and merged by prefix.
4. A node's smallest member owns it.  What a conversation saves is the text of turns it doesn't own, and a childless
   node is a leaf of its owner, so both are sums over members: the families are walked once more, with one
   row a conversation, and partial sums are merged.  Nothing is repeated for each level of depth.
5. Conversations that end at a node come as one list a family; lists follow each other in order of families,
   so one pass over sorted rows hashes them without holding them.

Defined results: a null turn comes first, equal turns are in order of role and text, repeated rows are turns of their
own; null role or text is empty; rows without conversation are left out; % is the remainder with the dividend's
sign, so families of negative ids mirror those of positive ones; an empty table gives no nodes; further columns are
not looked at.  Prefixes are told by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .textkit import mix

FAMILY, OPENING = 100, 5
#: Turns of a chunk; more than OPENING.
CHUNK = 4096
#: Bytes of a turn in a chunk: two hashes and the number of code points.
TURN = np.dtype([("a", "<u8"), ("b", "<u8"), ("size", "<u4")])
KEY = ["z1", "z2", "depth"]
NODES = "z1 long, z2 long, depth long, up1 long, up2 long, size long, base long, conv_id long, n long, ends string"
SUMS = "z1 long, z2 long, depth long, saved long, leaves long"
_KEYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def opening_turns(conv: int) -> int:
    return crc32(str(conv).encode()) % (OPENING + 1)


def chunks(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, base, block, start, body): consecutive turns of a conversation, ``start`` counted from its first."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    order = ("conv_id", "turn", "role", "text")
    d = d.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, start, body, out = None, 0, 0, bytearray(), []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["conv_id", "part", "start", "body"])

        for b in batches:
            for c, p, role, t in zip(*(b.column(x).to_pylist() for x in ("conv_id", "part", "role", "text")), strict=True):
                if body and (c != conv or len(body) == chunk * TURN.itemsize):
                    out.append((conv, part, start, bytes(body)))
                    start += len(body) // TURN.itemsize
                    body.clear()
                if c != conv:
                    conv, start = c, 0
                part = p
                body += blake2b(f"{len(role)}:{role}{t}".encode(), digest_size=16).digest() + len(t).to_bytes(4, "little")
            if len(out) > 512:
                yield rows()
                out.clear()
        if body:
            out.append((conv, part, start, bytes(body)))
        if out:
            yield rows()

    d = cut(d.mapInArrow(run, "conv_id long, part int, start long, body binary"), "chunks")
    n = (F.length("body") / TURN.itemsize).cast("long")
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # only the first conversation of a task can go on from an earlier one: at most a row for each task
    went_on = d.groupBy("conv_id", "part").agg(F.sum(n).alias("n")).withColumn("earlier", earlier).filter("earlier > 0").drop("n")
    d = d.join(F.broadcast(went_on), ["conv_id", "part"], "left").withColumn("start", F.col("start") + F.coalesce("earlier", F.lit(0)))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    return d.select("conv_id", base.alias("base"), F.expr(f"start div {chunk}").alias("block"), "start", "body")


def zobrist(turns: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of turns at places ``first`` and on."""
    place = np.arange(first, first + len(turns), dtype=np.uint64)
    with np.errstate(over="ignore"):
        return mix(turns["a"] ^ mix(place + _KEYS[0])), mix(turns["b"] ^ mix(place + _KEYS[1]))


def read(bodies: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bodies), TURN)


def rebuilt(conv: int, own: np.ndarray, start: int, opening: np.ndarray) -> tuple[np.ndarray, int]:
    """The rebuilt turns that a stretch holds, and the place of the first; ``own`` are the conversation's from ``start`` on."""
    h = opening_turns(conv)
    shift = min(h, len(opening)) - h
    if start:
        return own, start + shift
    return np.concatenate((opening[:h], own[h:])), 0


def contexts(parts: DataFrame, opening: DataFrame, chunk: int) -> DataFrame:
    """For conversations of several stretches, a row for each: hash and size of all before, size of all after."""
    long = parts.filter(f"start >= {chunk}").select("conv_id").distinct()
    d = parts.join(long, "conv_id", "left_semi").join(opening.groupBy("base").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "body"))), lambda x: x["body"]).alias("opening")), "base", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                first = read(r["opening"] or [])[:OPENING]
                h, turns = opening_turns(r["conv_id"]), read([r["body"]])
                kept = turns[max(0, h - r["start"]) :]  # a chunk may begin among the first h
                place = max(h, r["start"]) + min(h, len(first)) - h
                z = [np.bitwise_xor.reduce(x, initial=np.uint64(0)) for x in zobrist(kept, place)]
                size = int(kept["size"].sum())
                if not r["start"]:
                    z = [x ^ np.bitwise_xor.reduce(y, initial=np.uint64(0)) for x, y in zip(z, zobrist(first[:h], 0), strict=True)]
                    size += int(first[:h]["size"].sum())
                out.append((r["base"], r["block"], r["conv_id"], *(int(x.view(np.int64)) for x in z), size, min(h, len(first)) - h))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], ["base", "block", "conv_id", "z1", "z2", "size", "shift"])

    sums = d.select("base", "block", "conv_id", "start", "body", "opening").mapInArrow(run, "base long, block long, conv_id long, z1 long, z2 long, size long, shift long")
    sums = sums.groupBy("base", "conv_id", "block").agg(F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"), F.sum("size").alias("size"), F.first("shift").alias("shift"))
    w = Window.partitionBy("conv_id").orderBy("block")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    return sums.select(
        "base", "block", "conv_id", *(F.coalesce(F.bit_xor(z).over(before), zero).alias(z) for z in ("z1", "z2")),
        F.coalesce(F.sum("size").over(before), zero).alias("before"), F.coalesce(F.sum("size").over(after), F.lit(-1)).alias("after"), "shift",
    )


class Family:
    """The conversations of a family in one stretch, each with the prefixes that end there."""

    def __init__(self, own: pa.Table, about: pa.Table) -> None:
        rows = sorted(own.to_pylist(), key=lambda r: (r["conv_id"], r["start"]))
        about = about.to_pylist()
        opening = read([r["body"] for r in sorted((r for r in about if r["body"] is not None), key=lambda r: r["start"])])[:OPENING]
        context = {r["conv_id"]: r for r in about if r["body"] is None}
        self.base = rows[0]["base"]
        self.root = not rows[0]["block"]
        self.each = []  # (row, z1, z2, place of the first, sizes, size before, size after or -1)
        for conv, mine in groupby(rows, key=lambda r: r["conv_id"]):
            mine = list(mine)
            c = context.get(conv, {"z1": 0, "z2": 0, "before": 0, "after": -1, "shift": 0})
            turns = read([r["body"] for r in mine])
            if self.root:
                turns, place = rebuilt(conv, turns, 0, opening)
            else:
                place = mine[0]["start"] + c["shift"]
            z = [np.bitwise_xor.accumulate(np.concatenate((np.array([s], np.int64).view(np.uint64), x))).view(np.int64) for s, x in zip((c["z1"], c["z2"]), zobrist(turns, place), strict=True)]
            self.each.append((mine[0], *z, place, turns["size"].astype(np.int64), c["before"], c["after"]))

    def columns(self, *more) -> list[np.ndarray]:
        """Of each prefix: z1, z2, depth, those of its parent, size of the last turn, and what ``more`` tells of a conversation."""
        parts = [[] for _ in range(6 + len(more))]
        for e in self.each:
            row, z1, z2, place, sizes = e[:5]
            skip = 0 if self.root else 1  # the root and its like: of a later stretch, the last prefix of the one before
            up = [np.concatenate((z[:1], z[:-1])) for z in (z1, z2)]
            own = (z1, z2, np.arange(place, place + len(z1)), *up, np.concatenate(([0], sizes)))
            for p, x in zip(parts, (*own, *(m(*e) for m in more)), strict=True):
                p.append(x[skip:])
        return [np.concatenate(p) for p in parts]

    @staticmethod
    def combine(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        order = np.lexsort(cols[:3][::-1])
        cols = [c[order] for c in cols]
        new = np.ones(len(order), bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
        return cols, np.flatnonzero(new), order

    def nodes(self) -> pa.Table:
        """The family's trie: prefixes with their smallest member, members, and those that end there."""
        conv = lambda row, z1, *_: np.full(len(z1), row["conv_id"])
        last = lambda row, z1, z2, place, sizes, before, after: (np.arange(len(z1)) == len(z1) - 1) & (after < 0)
        cols, at, _ = self.combine(self.columns(conv, last))
        ends = [",".join(map(str, np.sort(c[e]))) or None for c, e in zip(np.split(cols[6], at[1:]), np.split(cols[7], at[1:]), strict=True)] if len(at) else []
        n = np.diff(np.append(at, len(cols[0])))
        low = np.minimum.reduceat(cols[6], at) if len(at) else cols[6]
        data = [*(pa.array(c[at], pa.int64()) for c in cols[:6]), pa.array(np.full(len(at), self.base), pa.int64()), pa.array(low, pa.int64()), pa.array(n, pa.int64()), pa.array(ends, pa.string())]
        return pa.Table.from_arrays(data, [x.split()[0] for x in NODES.split(", ")])

    def sums(self) -> pa.Table:
        """Of each prefix: code points from it on that its members here don't own, and the leaves they own."""
        def saved(row, z1, z2, place, sizes, before, after):
            here = np.concatenate(([0], np.cumsum(sizes)))
            shared = before + here[-1] + max(after, 0) - (row["owned"] or 0)  # owned turns are the last ones
            return np.maximum(shared - before - np.concatenate(([0], here[:-1])), 0)

        leaf = lambda row, z1, *_: np.full(len(z1), int(row["leaf"] or 0))
        cols, at, _ = self.combine(self.columns(saved, leaf))
        add = [np.add.reduceat(c, at) if len(at) else c for c in cols[6:]]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (*(c[at] for c in cols[:3]), *add)], [x.split()[0] for x in SUMS.split(", ")])


def _empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.table({x.split()[0]: pa.array([], kinds[x.split()[1]]) for x in schema.split(", ")})


def end_hashes(family_nodes: DataFrame) -> DataFrame:
    """(z1, z2, depth, ends_sha256) of nodes where conversations end."""
    d = family_nodes.filter("ends is not null").select(*KEY, "base", "ends").repartition(*KEY).sortWithinPartitions(*KEY, "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, waiting, text, some, out = None, None, [], None, False, []

        def put() -> None:
            nonlocal some
            if waiting:  # one family's, of one stretch or two
                text.update(("," * some + ",".join(map(str, sorted(waiting)))).encode())
                some = True
                waiting.clear()

        for b in batches:
            for *k, f, ends in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if k != key:
                    put()
                    if key:
                        out.append((*key, text.hexdigest()))
                    key, base, text, some = k, f, sha256(), False
                if f != base:
                    put()
                    base = f
                waiting.extend(map(int, ends.split(",")))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "ends_sha256"), r, strict=True)) for r in out])
                out.clear()
        put()
        if key:
            yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "ends_sha256"), (*key, text.hexdigest()), strict=True))])

    return d.mapInArrow(run, "z1 long, z2 long, depth long, ends_sha256 string")


def trie(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    parts = cut(chunks(conversations, chunk), "parts")
    opening = parts.filter(f"conv_id = base and start < {OPENING}").select("base", "start", F.substring("body", 1, OPENING * TURN.itemsize).alias("body"))
    context = contexts(parts, opening, chunk)
    about = cut(opening.withColumn("block", F.lit(0).cast("long")).unionByName(context, allowMissingColumns=True), "about")
    about = about.groupBy("base", "block")

    def build(own: pa.Table, about: pa.Table) -> pa.Table:
        return Family(own, about).nodes() if own.num_rows else _empty(NODES)

    def add(own: pa.Table, about: pa.Table) -> pa.Table:
        return Family(own, about).sums() if own.num_rows else _empty(SUMS)

    family_nodes = cut(parts.groupBy("base", "block").cogroup(about).applyInArrow(build, NODES), "family-nodes")
    same = [F.first(c).alias(c) for c in ("up1", "up2", "size")]
    nodes = cut(family_nodes.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), *same), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("up1").alias("z1"), F.col("up2").alias("z2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, KEY, "left").fillna(0, ["n_children"]), "nodes")
    owners = nodes.groupBy("conv_id").agg(F.sum("size").alias("owned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    again = parts.join(owners, "conv_id", "left")
    sums = again.groupBy("base", "block").cogroup(about).applyInArrow(add, SUMS).groupBy(*KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    parents = nodes.select(F.col("z1").alias("up1"), F.col("z2").alias("up2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, KEY).join(end_hashes(family_nodes), KEY, "left").join(parents, ["up1", "up2", "depth"], "left")
    ends = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))
