"""Operator 8, n-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A document is the set of its distinct five-word shingles (64-bit hashes).  Copies of one set are
one class, found by a 128-bit set hash; only class representatives are joined.

Tiles.  Sets are banded by size, a band holding sizes up to twice its least.  In a band the hash
range is dealt into segments of one to two and a half shingles on average.  Two linked sets of sizes s <= t differ
in at most (s + t) / 9 shingles, so in at most d = floor(s / 4) segments (t is at most s / 0.8).
Take each set's segments as elements, in the global order (more shingles first, then by hash; empty
segments come last): by the prefix principle two linked sets share one among the first d + 1 of each.
Those are the tiles (band, segment, contents) that a set enters; a set whose partner may be in the lower
band enters that band's tiles too.  Bands of small sets have tiles of single shingles.  No link is lost.

Work within tiles is done in two steps.  `ROUNDS` rounds pair a tile's members with one leader of the
tile's largest component; tiles choose by several orders of the documents, so that a group with many
tiles has many leaders.  Bit counts of the bitmap signatures bound a pair's overlap from above (each
differing bit is a differing shingle), and survivors are verified by intersecting sorted arrays.  This
joins nearly all links at the cost of one pair a tile member.  Then the members of different components
that still share a tile are compared inside one task a group, in blocks: the bitmap bound
leaves the members that have any possible partner, and the exact intersections of these give the links
that connect them.  So a task hands on at most one row a member, never all the pairs of a group.

Defined results: null, empty and word-less texts have empty sets and link with nothing; fewer than
five words make one shingle; equal texts are always linked; ties don't matter (links are
symmetric); rows repeated under one id get equal results; rows with a null id link with nothing and
have a null component; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import components, cut

SHINGLE = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Segments of a band, by its least size: one to two and a half shingles a segment.
SEGMENTS = 0.8
#: Sets below this size use one shingle a segment.
SMALL = 24
#: Bits of a bitmap signature for each shingle of the band's least size; lengths are powers of two, so a
#: bitmap is folded to half by joining its halves.
BITS = 8
#: Members of a tile compared in one block with one other: at most BLOCK, and fewer if their sets hold over CELLS shingles.
BLOCK, CELLS = 512, 1 << 18
#: Orders by which tiles choose their leaders, and rounds of choosing.
ORDERS, ROUNDS = 3, 3
#: Bits of a tile's slot: its rows are sorted together, so slots are many and small.
SLOTS = 12
#: Bits of the bitmap of wanted documents, however many they are: 2 MB, as rows of a word and its place 4 MB and more.
MARKS = 1 << 24
#: Columns of the member-by-shingle matrix held at once.
COLUMNS = 4096


def set_hashes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, n, s1, s2, bits): size, 128-bit hash and bitmap signature of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.blocks(batches):
            v, at = tk.shingles(tk.words(b.column("text")), SHINGLE)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), pa.array(np.diff(at)), *map(tk.signed, _set_sums(v, at)), _bitmaps(v, at)], ["doc", "n", "s1", "s2", "bits"]
            )

    return docs.selectExpr(f"`{key}` as doc", f"`{text}` as text").mapInArrow(run, "doc long, n long, s1 long, s2 long, bits array<bigint>")


def _bitmaps(v: np.ndarray, at: np.ndarray) -> pa.Array:
    """Each set's bitmap: `BITS` bits for each shingle of its band's least size, at least one word."""
    n = np.diff(at)
    own = 1 << np.maximum(np.frexp(n)[1] - 1, 0).astype(np.int64)
    length = np.maximum(own * BITS // 64, 1)
    ends = np.concatenate(([0], np.cumsum(length)))
    bit = np.zeros(int(ends[-1]) * 64, bool)
    bit[np.repeat(ends[:-1] * 64, n) + (tk.mix(v) & np.repeat((length * 64 - 1).astype(np.uint64), n)).astype(np.int64)] = True
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.packbits(bit, bitorder="little").view(np.int64)))


def _set_sums(v: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    out = []
    for salt in (0x51ED270B, 0xB5297A4D):
        total = np.concatenate(([np.uint64(0)], np.cumsum(tk.mix(v ^ np.uint64(salt)))))
        out.append(total[at[1:]] - total[at[:-1]])
    return out


def _segments(v: np.ndarray, low: int) -> np.ndarray:
    """Hashes of the tiles that the sorted set v enters in the band of sizes from ``low`` on.  A set
    with fewer than d + 1 non-empty segments enters tiles of empty ones too."""
    d = len(v) // 4  # a bound of the differing segments, for v as the smaller or the larger set
    total = int(low * SEGMENTS)
    seg = (v >> np.uint64(32)) * np.uint64(total) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    size = np.diff(np.append(first, len(v)))
    content = np.add.reduceat(tk.mix(v), first)
    name = tk.mix(content ^ tk.mix(seg[first] + np.uint64(low << 20)))
    out = name[np.lexsort((name, -size))[: d + 1]]
    if len(out) <= d:
        empty = np.setdiff1d(np.arange(total, dtype=np.uint64), seg[first])
        out = np.append(out, np.sort(tk.mix(tk.mix(empty + np.uint64(low << 20))))[: d + 1 - len(out)])
    return out


def _tiles_of(v: np.ndarray) -> np.ndarray:
    out = [np.zeros(0, np.uint64)]
    for low in _bands(len(v)):
        out.append(_segments(v, low) if low >= SMALL else np.sort(tk.mix(v ^ np.uint64(low * 2 + 1)))[: len(v) // 4 + 1])
    return np.concatenate(out)


def _bands(n: int) -> list[int]:
    """Least sizes of the bands in which a set of n shingles is tiled: its own, and the lower one if
    a set of 0.8 n would be there."""
    n = int(n)
    if n == 0:
        return []
    own = 1 << (n.bit_length() - 1)
    return [own, own // 2] if own > 1 and (n * PERCENT + 99) // 100 < own else [own]


def tiles(docs: DataFrame) -> DataFrame:
    """(slot, low, doc): the tiles that documents, (doc, text), enter, dealt by slot, the first bits of a name; ``low`` is
    the next 32, and names equal so far count as one tile.  Only names move, no text: a row for each slot of a batch, so
    that their bytes don't depend on the number of partitions.  Of the rows of a batch with equal sets only the
    one of smallest id enters: the others can't represent their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.blocks(batches):
            v, at = tk.shingles(tk.words(b.column("text")), SHINGLE)
            doc, sums = b.column("doc").to_numpy(), np.stack([np.diff(at), *(x.view(np.int64) for x in _set_sums(v, at))])
            order = np.lexsort((doc, *sums))
            first = np.append(True, (sums[:, order[1:]] != sums[:, order[:-1]]).any(0))
            rows = np.sort(order[first])
            names = [_tiles_of(v[at[i] : at[i + 1]]) for i in rows]
            owner, names = np.repeat(doc[rows], [*map(len, names)]), np.concatenate(names)
            slot = (names >> np.uint64(64 - SLOTS)).astype(np.int32)
            order = np.argsort(slot, kind="stable")
            slot, owner, low = slot[order], owner[order], (names[order] >> np.uint64(32 - SLOTS)).astype(np.uint32).view(np.int32)
            first = np.flatnonzero(np.diff(slot, prepend=-1))
            ends = pa.array(np.append(first, len(slot)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot[first]), pa.ListArray.from_arrays(ends, pa.array(low)), pa.ListArray.from_arrays(ends, pa.array(owner))], ["slot", "lows", "docs"]
            )

    entered = docs.select("doc", "text").mapInArrow(run, "slot int, lows array<int>, docs array<bigint>").repartition("slot")
    return entered.select("slot", F.inline(F.arrays_zip("lows", "docs")).alias("low", "doc"))


def shared(entered: DataFrame) -> DataFrame:
    """(tile, doc, m, w, x, y, z) of the tiles that hold two rows at least, where `tiles` dealt them.  Members are told by
    their number and sums of two hashes (in halves, which can't overflow), so no tile is gathered."""
    half = lambda h, k: F.sum(F.shiftrightunsigned(h, 32) if k else h.bitwiseAND(F.lit(0xFFFFFFFF)))
    a, b = F.xxhash64("doc"), F.xxhash64("doc", F.lit(1))
    told = {"m": F.count("*"), "w": half(a, 0), "x": half(a, 1), "y": half(b, 0), "z": half(b, 1)}
    own = Window.partitionBy("slot", "low")
    tile = F.shiftleft(F.col("slot").cast("long"), 32) + F.col("low")
    return entered.select(tile.alias("tile"), "doc", *(c.over(own).alias(k) for k, c in told.items())).filter("m > 1")


def crowded(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(tile, doc): the tiles in which two representatives at least meet; of those with the same members the least."""
    met = cut(shared(tiles(docs)), "met")
    least = met.groupBy("m", "w", "x", "y", "z").agg(F.min("tile").alias("tile")).select("tile")
    named = met.select("tile", "doc").join(least, "tile", "left_semi").join(reps.select("doc"), "doc", "left_semi")
    few = named.groupBy("tile").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("tile")
    return named.join(few, "tile", "left_semi")


def bounded(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps leave a link possible."""

    def side(x: str) -> DataFrame:
        return sig.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))

    def folded(x: str, words: Column) -> Column:
        y = F.col(f"bits{x}")
        return F.when(F.size(y) <= words, y).otherwise(F.zip_with(F.slice(y, F.lit(1), words), F.slice(y, words + 1, words), lambda p, q: p.bitwiseOR(q)))

    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("words", F.least(F.size("bitsa"), F.size("bitsb")))
    both = both.filter((100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")))  # so lengths differ by one doubling at most
    both = both.select("a", "b", "na", "nb", folded("a", F.col("words")).alias("x"), folded("b", F.col("words")).alias("y"))
    apart = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + c)
    # differing shingles are at least `apart`: the overlap is at most (na + nb - apart) / 2
    most = F.floor((F.col("na") + F.col("nb") - apart) / 2)
    most = F.least(most, F.col("na"), F.col("nb"))
    return both.filter(100 * most >= PERCENT * (F.col("na") + F.col("nb") - most)).select("a", "b")


def of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc is in ``wanted``, (doc,), distinct.  A bitmap of `MARKS` hashed ids, which every task gets,
    drops nearly all others where they are read, so that their texts don't move; the join is exact (a semi join would be
    put before the bitmap's)."""
    mark = F.pmod(F.xxhash64("doc"), F.lit(MARKS))
    word, bit = F.shiftright(mark, 6), F.expr("shiftleft(1L, cast(mark % 64 as int))")
    words = wanted.select(word.alias("word"), mark.alias("mark")).groupBy("word").agg(F.bit_or(bit).alias("bits"))
    marked = docs.withColumn("word", word).withColumn("mark", mark).join(F.broadcast(words), "word")
    return marked.filter(F.col("bits").bitwiseAND(bit) != 0).select(*docs.columns).join(wanted, "doc")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that link, by exact intersection of sorted arrays.  ``sets``: (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.blocks(tk.blocks(batches, "ta"), "tb"):
            va, at = tk.shingles(tk.words(b.column("ta")), SHINGLE)
            vb, bt = tk.shingles(tk.words(b.column("tb")), SHINGLE)
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = va[at[i] : at[i + 1]], vb[bt[i] : bt[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= PERCENT * (len(x) + len(y) - both)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    held = cut(of(sets, wanted), "texts")
    one = held.select(F.col("doc").alias("b"), F.col("text").alias("tb"))
    two = held.select(F.col("doc").alias("a"), F.col("text").alias("ta"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, n_shingles, component): every document with the smallest document it is linked to,
    directly or through others."""
    every = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    docs, unnamed = every.filter("doc is not null"), every.filter("doc is null")
    sizes = cut(set_hashes(docs, "text", "doc"), "sets")
    reps = sizes.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc").alias("doc"))

    crowd = cut(crowded(docs, reps), "tiles")
    sig = sizes.select("doc", "n", "bits").dropDuplicates(["doc"])
    sig = cut(sig.join(crowd.select("doc").distinct(), "doc", "left_semi"), "signatures")

    comp = sig.select("doc", F.col("doc").alias("component"))
    links = tried = None
    mixed = crowd.withColumn("component", F.col("doc"))
    for turn in range(ROUNDS):
        pairs = led(mixed, turn)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        passed = cut(bounded(pairs, sig), "pairs")
        found = cut(verified(passed, docs), "links")
        tried = passed if tried is None else tried.unionByName(passed)
        if links is not None and found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        comp = components(links).withColumnRenamed("node", "doc")
        mixed = cut(still_apart(mixed.drop("component"), comp), "mixed")

    more = cut(connecting(mixed, sig, docs), "links")
    comp = components(links.unionByName(more)).withColumnRenamed("node", "doc")

    # one row a class before the join with its documents, so that a class of many is a skewed join like any other
    named = reps.join(comp, "doc", "left").select("s1", "s2", "n", F.coalesce("component", "doc").alias("component"))
    classed = sizes.filter("n > 0").select("doc", "n", "s1", "s2").join(named, ["s1", "s2", "n"]).select("doc", "n", "component")
    alone = sizes.filter("n = 0").select("doc", "n").unionByName(set_hashes(unnamed, "text", "doc").select("doc", "n"))
    out = classed.unionByName(alone.withColumn("component", F.col("doc")))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def led(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): each tile's leader, of the tile's largest component, with every member of another one."""
    order = F.struct(F.xxhash64("doc", F.pmod("tile", F.lit(ORDERS)), F.lit(turn)).alias("turn"), F.col("doc"))
    if turn == 0:  # every member is a component
        chief = members.groupBy("tile").agg(F.min(order)["doc"].alias("leader")).withColumn("main", F.col("leader"))
    else:
        share = members.groupBy("tile", "component").agg(F.count("*").alias("m"), F.min(order)["doc"].alias("leader"))
        most = F.max(F.struct("m", "component", "leader"))
        chief = share.groupBy("tile").agg(most.alias("x")).select("tile", "x.leader", F.col("x.component").alias("main"))
    met = members.join(chief, "tile").filter("component <> main")
    return met.select(F.least("leader", "doc").alias("a"), F.greatest("leader", "doc").alias("b")).distinct()


def still_apart(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(tile, doc, component) of the tiles that hold more than one component."""
    named = members.join(comp, "doc", "left").select("tile", "doc", F.coalesce("component", "doc").alias("component"))
    open_ = named.groupBy("tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    return named.join(open_.select("tile"), "tile", "left_semi")


def connecting(mixed: DataFrame, sig: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that connect the components meeting in the tiles of ``mixed``, as exact comparison of
    all their members would."""
    groups = dealt(mixed.join(sig.select("doc", "n"), "doc"))
    members = groups.join(sig.select("doc", "bits", "n"), "doc")
    lists = members.groupBy("tile", "i", "j").agg(F.collect_list(F.struct("doc", "component", "n", "bits")).alias("members"))
    near = cut(lists.select("members").mapInArrow(_near, "docs array<bigint>, components array<bigint>"), "near")
    near = near.dropDuplicates(["docs"]).withColumn("g", F.struct(F.xxhash64("docs"), F.hash("docs")))
    one = near.select("g", F.explode(F.arrays_zip("docs", "components")).alias("x")).select("g", F.col("x.docs").alias("doc"), F.col("x.components").alias("component"))
    sets = shingle_sets(of(docs, one.select("doc").distinct()).dropDuplicates(["doc"]))
    held = one.join(sets, "doc").groupBy("g").agg(F.collect_list(F.struct("doc", "component", "v")).alias("members"))
    return held.select("members").mapInArrow(_links, "a long, b long").distinct()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc, v): sorted shingle hashes, of (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.blocks(batches):
            v, at = tk.shingles(tk.words(b.column("text")), SHINGLE)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), tk.signed(v))], ["doc", "v"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, v array<bigint>")


def dealt(members: DataFrame) -> DataFrame:
    """The groups (tile, i, j) in which the members of tiles, (tile, doc, component, n), are compared.
    A tile of one block is one group, and equal ones count once.  In a larger tile every pair of components
    has a member outside the largest one: those outside, in blocks i, meet all members, in blocks j."""
    share = members.groupBy("tile", "component").agg(F.count("*").alias("m"), F.max("n").alias("n"))
    most = F.max(F.struct("m", "component"))
    tile = share.groupBy("tile").agg(F.sum("m").alias("m"), F.max("n").alias("n"), most["m"].alias("mm"), most["component"].alias("main"))
    block = F.least(F.lit(BLOCK), F.greatest(F.lit(8), F.floor(F.lit(CELLS) / F.col("n")))).cast("int")
    tile = tile.select("tile", "main", F.ceil(F.col("m") / block).cast("int").alias("all"), F.ceil((F.col("m") - F.col("mm")) / block).cast("int").alias("out"))
    met = members.select("tile", "doc", "component").join(tile, "tile")

    few = met.filter("all = 1").groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("doc", "component"))).alias("members"))
    few = few.withColumn("size", F.size("members")).withColumn("mark", F.hash("members")).withColumn("tile", F.xxhash64("members"))
    few = few.dropDuplicates(["tile", "mark", "size"]).select("tile", F.col("mark").alias("i"), F.lit(-1).alias("j"), F.explode("members").alias("x"))
    many = met.filter("all > 1").withColumn("y", F.pmod(F.xxhash64("doc"), "all").cast("int")).withColumn("x", F.pmod(F.xxhash64("doc", F.lit(1)), "out").cast("int"))
    last = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    inner = F.transform(last("out"), lambda i: F.struct(i.alias("i"), F.col("y").alias("j")))
    outer = F.transform(last("all"), lambda j: F.struct(F.col("x").alias("i"), j.alias("j")))
    where = F.when(F.col("component") == F.col("main"), inner).otherwise(F.array_distinct(F.concat(inner, outer)))
    many = many.select("tile", "doc", "component", F.explode(where).alias("at")).select("tile", "at.i", "at.j", "doc", "component")
    return few.select("tile", "i", "j", "x.doc", "x.component").unionByName(many)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each group that have, in another component, a member whose size and bitmap leave a
    link possible; groups without any give no row."""
    for batch in batches:
        lists = batch.column("members")
        ends, flat = lists.offsets.to_numpy(), lists.values
        flat, ends = flat.slice(ends[0], ends[-1] - ends[0]), ends - ends[0]
        doc, comp, n = (flat.field(c).to_numpy() for c in ("doc", "component", "n"))
        size, group = np.diff(ends), np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        order = np.lexsort((n, group))
        maps = flat.field("bits")
        borders = maps.offsets.to_numpy()
        begin, words = borders[:-1][order], np.diff(borders)[order]
        doc, comp, n, word = doc[order], comp[order], n[order], maps.values.to_numpy().view(np.uint64)
        least = np.minimum.reduceat(words, ends[:-1])[group]  # each group is compared at its shortest length
        hit = np.zeros(len(doc), bool)

        def folded(rows: np.ndarray, size_: int) -> np.ndarray:
            at = begin[rows][:, None] + np.arange(size_)
            own, long = word[at], words[rows] > size_
            own[long] |= word[at[long] + size_]
            return own

        def test(i: np.ndarray, j: np.ndarray) -> None:  # n[i] <= n[j]
            # two of the longer kind meet in their own band's tiles
            ok = (comp[i] != comp[j]) & (n[i] * 100 >= n[j] * PERCENT) & ((words[i] == least[i]) | (words[j] == least[j]))
            i, j = i[ok], j[ok]
            for size_ in np.unique(least[i]):
                part = np.flatnonzero(least[i] == size_)
                step = max(1, (1 << 20) // int(size_))
                for at in range(0, len(part), step):
                    a, b = i[part[at : at + step]], j[part[at : at + step]]
                    apart = np.bitwise_count(folded(a, size_) ^ folded(b, size_)).sum(1, dtype=np.int64)
                    most = np.minimum((n[a] + n[b] - apart) // 2, n[a])
                    near = 100 * most >= PERCENT * (n[a] + n[b] - most)
                    hit[a[near]] = hit[b[near]] = True

        for s in range(1, 9):  # the few members of many groups: all groups at once, by distance
            at = np.flatnonzero(np.arange(len(doc)) + s < np.repeat(ends[1:], size))
            at = at[np.repeat(size, size)[at] <= 9]
            test(at, at + s)
        for g in np.flatnonzero(size > 9):
            lo, hi = ends[g], ends[g + 1]
            reach = lo + np.searchsorted(n[lo:hi], n[lo:hi] * 100 // PERCENT, "right")
            counts = np.maximum(reach - np.arange(lo + 1, hi + 1), 0)
            i = np.repeat(np.arange(lo, hi), counts)
            test(i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts))
        left = np.lexsort((doc, group))  # equal survivors of different tiles are told by equal lists
        left = left[hit[left]]
        kept = np.bincount(group[left], minlength=len(size))
        offsets = pa.array(np.concatenate(([0], np.cumsum(kept[kept > 0]))), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(offsets, pa.array(doc[left])), pa.ListArray.from_arrays(offsets, pa.array(comp[left]))], ["docs", "components"]
        )


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group's members, (doc, component, v), that connect what is linked: at most one a member.
    Intersections are exact: products of the member-by-shingle matrix of the shingles that two members have."""
    for batch in batches:
        lists = batch.column("members")
        out = [np.zeros((0, 2), np.int64)]
        for g in range(len(lists)):
            flat = lists[g].values
            doc, comp = flat.field("doc").to_numpy(), flat.field("component").to_numpy()
            sets = flat.field("v")
            at = sets.offsets.to_numpy()
            n, m = np.diff(at), len(doc)
            value, column, times = np.unique(sets.values.to_numpy()[at[0] : at[-1]], return_inverse=True, return_counts=True)
            shared = np.flatnonzero(times > 1)
            place = np.full(len(value), -1)
            place[shared] = np.arange(len(shared))
            row, column = np.repeat(np.arange(m), n), place[column]
            both = np.zeros((m, m), np.int64)
            for c in range(0, len(shared), COLUMNS):
                part = np.zeros((m, min(COLUMNS, len(shared) - c)), np.float32)
                here = (column >= c) & (column < c + COLUMNS)
                part[row[here], column[here] - c] = 1
                both += (part @ part.T).astype(np.int64)
            linked = 100 * both >= PERCENT * (n[:, None] + n[None, :] - both)
            out.append(doc[_spanning(linked, comp)])
        pairs = np.sort(np.concatenate(out), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _spanning(linked: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Index pairs, of ``linked``, that join all that is linked, given that equal ``comp`` are joined already."""
    seen, edges = np.zeros(len(comp), bool), []
    for start in range(len(comp)):
        if seen[start]:
            continue
        todo = list(np.flatnonzero(comp == comp[start]))
        seen[todo] = True
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(linked[i] & ~seen):
                if not seen[j]:
                    edges.append((i, j))
                    mates = np.flatnonzero(comp == comp[j])
                    seen[mates] = True
                    todo.extend(mates)
    return np.array(edges, np.int64).reshape(-1, 2)
