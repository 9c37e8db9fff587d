"""Operator 12, mixing sources to target weights: a low-discrepancy source schedule.

Sources share ``share`` percent of all words by weight; a source's target stops at ``epochs`` times
its own words, and what is above goes to the others by weight (water filling, exact: sources ordered
by words over weight, sums before each, all in whole numbers).

A source's documents are shuffled (ordered by a hash), laid end to end, and cut into blocks of equal
words.  Slots 0, 1, ... are golden-ratio points, mapped through the sources' cumulative numbers of
blocks, so that every stretch of the schedule holds each source by its share.  The slots of a source are
ranked, and its k-th slot takes its k-th block; past its last block a source starts over, up to
``epochs`` times.  Points fall unevenly by a few: slots beyond a source's last block are
dropped, and blocks that no slot took follow after the schedule, so each source takes its rounded target exactly.

A source may hold most rows: its order is summed in parts of the hash range, its slots are ranked in
stretches, and blocks are joined by source and number.  Only built-in functions are used.  The
driver sees one number, that of blocks; sources themselves are ordered in one task, a row for each.

Defined results: a null text has no words; a document without words takes none; a null source is a source of
its own, the last; documents without id are mixed like others; rows repeated under one id are documents of
their own, in order of size; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .quality_rules import SPACES

WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 150, 2
#: Words of a block.
BLOCK = 2048
#: Points of the golden-ratio sequence before it repeats, and its step: the golden ratio's share of them, made odd.
POINTS, STEP = 1 << 30, 663608941
#: Bits of the hash by which documents are shuffled, and those that choose the part in which they are summed.
HASH_BITS, PART_BITS = 60, 10
#: Slots of a stretch in which they are ranked, and cells of the schedule's range by which sources are found.
STRETCH, CELLS = 1 << 16, 1024
SEED = "mix"


def n_words(text: Column) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def _before(*order: Column | str, by: tuple[str, ...] = ()) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _none(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, rank, weight, source_size, target) of each source; ``sized`` has source and size."""
    big = "decimal(38,0)"
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("long"))
    s = s.withColumn("most", epochs * F.col("source_size"))
    s = s.withColumn("level", F.col("most").cast(big) * F.lit(math.lcm(*weights)) / F.col("weight"))
    every, before = Window.partitionBy(), _before("level", "rank")
    # what is left, in hundredths of a word, and its weights, once all of lower level have their most
    left = share * F.sum("source_size").over(every) - 100 * _none(F.sum("most").over(before))
    s = s.withColumn("left", left).withColumn("rest", F.sum("weight").over(every) - _none(F.sum("weight").over(before)))
    s = s.withColumn("full", F.col("left").cast(big) * F.col("weight") >= F.col("most").cast(big) * 100 * F.col("rest"))
    shared = F.min(F.when(~F.col("full"), F.struct("level", "rank", "left", "rest"))).over(every)
    s = s.withColumn("shared", shared)
    part = (F.col("shared.left").cast(big) * F.col("weight")).cast("double") / (100 * F.col("shared.rest")).cast("double")
    return s.select("source", "rank", "weight", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(part).alias("target"))


def schedule(sources: DataFrame, total: int) -> DataFrame:
    """(rank, k, slot): which slot takes the k-th block of a source; ``sources`` has rank, blocks and the
    blocks of all sources before it (first)."""
    width = max(1, -(-total // CELLS))
    last = F.col("first") + F.col("blocks") - 1
    spans = sources.filter("blocks > 0").select(
        "rank", "blocks", "first", last.alias("last"), F.explode(F.sequence(F.expr(f"first div {width}"), F.expr(f"(first + blocks - 1) div {width}"))).alias("cell")
    )
    slots = sources.sparkSession.range(total).select(F.col("id").alias("slot"), (F.col("id") % POINTS * STEP % POINTS).alias("u"))
    slots = slots.select("slot", F.expr(f"u * {total} div {POINTS}").alias("at")).withColumn("cell", F.expr(f"at div {width}"))
    own = slots.join(spans, "cell").filter("at between first and last").select("rank", "blocks", "slot", F.expr(f"slot div {STRETCH}").alias("stretch"))
    counts = own.groupBy("rank", "stretch").count().withColumn("before", _none(F.sum("count").over(_before("stretch", by=("rank",)))))
    inside = F.row_number().over(Window.partitionBy("rank", "stretch").orderBy("slot")) - 1
    own = own.withColumn("inside", inside).join(counts.select("rank", "stretch", "before"), ["rank", "stretch"])
    return own.withColumn("k", F.col("inside") + F.col("before")).filter("k < blocks").select("rank", "k", "slot")


def pieces(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", by: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, epochs: int = EPOCHS, block: int = BLOCK,
) -> DataFrame:
    """What the mix reads: (key, doc_id, size, source_size, target, epoch, from_word, n, slot), a row for each part of a
    document in a block, words counted from 0; a document that isn't taken has one row without epoch.
    ``key`` tells documents apart; reading pieces by slot, then by their word in the source, gives the mix."""
    sized = cut(docs.select(F.col(f"`{ident}`").alias("doc_id"), F.col(f"`{by}`").alias("source"), n_words(F.col(f"`{text}`")).alias("size")), "sizes")
    s = targets(sized, weights, share, epochs).withColumn("words", F.round("target").cast("long"))
    s = s.withColumn("blocks", F.ceil(F.col("words") / block).cast("long")).withColumn("first", _none(F.sum("blocks").over(_before("rank"))))
    s = cut(s, "sources")
    total = s.agg(F.sum("blocks")).first()[0] or 0

    mark = F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    h = F.conv(F.left(F.md5(mark), F.lit(HASH_BITS // 4)), 16, 10).cast("long")
    mine = s.withColumnRenamed("source", "of")
    d = sized.join(mine, F.col("source").eqNullSafe(F.col("of"))).withColumn("h", h).withColumn("part", F.shiftright("h", HASH_BITS - PART_BITS))
    within = Window.partitionBy("rank", "part").orderBy("h", "doc_id", "size")
    d = d.withColumn("no", F.row_number().over(within)).withColumn("inside", _none(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1))))
    parts = d.groupBy("rank", "part").agg(F.sum("size").alias("n")).withColumn("before", _none(F.sum("n").over(_before("part", by=("rank",)))))
    d = d.join(parts.select("rank", "part", "before"), ["rank", "part"]).withColumn("at", F.col("inside") + F.col("before"))

    spans = F.array(*(F.struct(F.lit(e).alias("epoch"), (F.col("at") + e * F.col("source_size")).alias("a"), F.least(F.col("at") + e * F.col("source_size") + F.col("size"), F.col("words")).alias("b")) for e in range(epochs)))
    d = d.withColumn("span", F.explode_outer(F.filter(spans, lambda x: x["b"] > x["a"]))).select("*", "span.*")
    steps = F.when(F.col("epoch").isNotNull(), F.sequence(F.expr(f"a div {block}"), F.expr(f"(b - 1) div {block}")))
    d = d.withColumn("k", F.explode_outer(steps))
    lo, hi = F.greatest(F.col("a"), F.col("k") * block), F.least(F.col("b"), (F.col("k") + 1) * block)
    d = d.select(
        F.struct("rank", "part", "no").alias("key"), "doc_id", "size", "source_size", "target", "rank", "first", "k", "epoch",
        (lo - F.col("at") - F.col("epoch") * F.col("source_size")).alias("from_word"), (hi - lo).alias("n"),
    )
    d = d.join(schedule(s, total), ["rank", "k"], "left")
    slot = F.coalesce("slot", F.lit(total) + F.col("first") + F.col("k"))  # after the schedule
    return d.select("key", "doc_id", "size", "source_size", "target", "epoch", "from_word", "n", slot.alias("slot"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot) of each document; parameters as for `pieces`."""
    p = pieces(docs, **how)
    out = p.groupBy("key", "doc_id", "size", "source_size", "target").agg(_none(F.sum("n")).alias("taken"), F.min("slot").alias("first_slot"))
    return out.drop("key")
