"""Operator 6, embedding near-dedup: an inverted multi-index.

Unit vectors are halved; each half has a codebook of its own (k-means, numpy, on a bounded sample of
`SAMPLE` vectors), and the two codebooks form a product grid of cells.  Every vector is stored in
its cell.  A query walks the cells nearest first (multi-sequence traversal over the two sorted
lists of border distances) and stops where the target recall is met: the stop radius is the
`TARGET_RECALL` quantile, over simulated partners at the threshold's angle around sample vectors,
of the border distance of the partner's cell.  Candidates are verified by cosine in double precision.

Equal vectors of a label are one class, so a group of copies is one query and one stored row.
Cells are met in blocks of at most `BLOCK` queries and `BLOCK` stored rows; the number of blocks of a
cell follows from its counted rows, so a hot cell is dealt over many tasks.  Tasks return counts
and, for components, one link per vector and partner group, never all pairs of a group.

Defined results: vectors that are null, zero, or hold null or non-finite components link with
nothing, as do those without label or id; vectors of each length have an index of their own and
link among themselves; copies link, rows repeated under one id too; a vector without id is kept; an empty table
gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

THRESHOLD = 0.98
SAMPLE, TARGET_RECALL, SEED = 8192, 0.999, 11
#: Rows of either side of a block.
BLOCK = 2048
#: Vectors that a cell should hold, and sampled vectors that a centroid should rest on.
PER_CELL, PER_CENTROID = 64, 16


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (((c * c).sum(1)[None, :] - 2 * x @ c.T)).argmin(1)
        for j in range(k):
            if (own := near == j).any():
                c[j] = x[own].mean(0)
    return c


def border_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """How far each row must move, at least, to have each centroid as its nearest rather than the present one."""
    d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
    own = d.argmin(1)
    apart = np.sqrt(np.maximum(((c[:, None, :] - c[None, :, :]) ** 2).sum(2), 1e-30))[own]
    out = (d - d[np.arange(len(x)), own][:, None]) / (2 * apart)
    out[np.arange(len(x)), own] = 0
    return out


class MultiIndex:
    def __init__(self, sample: np.ndarray, k: int, threshold: float, recall: float, seed: int = SEED):
        self.half = sample.shape[1] // 2
        self.books = [codebook(sample[:, : self.half], k, seed), codebook(sample[:, self.half :], k, seed + 1)]
        self.k = k
        r = np.random.default_rng(seed)
        side = r.standard_normal(sample.shape)
        side -= (side * sample).sum(1, keepdims=True) * sample
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-30)
        partner = threshold * sample + np.sqrt(1 - threshold**2) * side
        a, b = self.distances(sample)
        i, j = self.cells(partner)
        rows = np.arange(len(sample))
        self.radius = float(np.quantile(np.hypot(a[rows, i], b[rows, j]), recall)) + 1e-9

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return border_distances(x[:, : self.half], self.books[0]), border_distances(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(d.argmin(1) for d in self.distances(x))

    def traverse(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cells by growing border distance, from the two lists of one query, up to the radius."""
        ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        x, y = a[ia] ** 2, b[ib] ** 2
        # the lists are sorted: each row of the grid ends where the radius is passed
        reach = np.searchsorted(y, self.radius**2 - x, "right")
        i = np.repeat(np.arange(self.k), reach)
        j = np.arange(len(i)) - np.repeat(np.cumsum(reach) - reach, reach)
        return (ia[i] * self.k + ib[j])[np.argsort(x[i] + y[j], kind="stable")]


def _unit(values: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square over- or underflows."""
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def near(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of every vector."""
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("e"), F.col(label).cast("string").alias("label"))
    sound = F.col("id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & F.col("label").isNotNull()
    sound = sound & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    v = v.withColumn("fit", F.coalesce(sound, F.lit(False)))
    fit = v.filter("fit")
    widths = [r["w"] for r in fit.select(F.size("e").alias("w")).distinct().orderBy("w").collect()]
    if not widths:
        return v.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    done = reduce(DataFrame.unionByName, [_linked(fit.filter(F.size("e") == w), threshold) for w in widths])
    return v.join(done, ["fit", "label", "e"], "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    ).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _linked(fit: DataFrame, threshold: float) -> DataFrame:
    """(fit, label, e, n_links, component_id) of each distinct vector; all are of one length."""
    classes = fit.groupBy("label", "e").agg(F.min("id").alias("c"), F.count("*").alias("m"))
    classes = cut(classes, "classes")

    n, labels = classes.count(), classes.select("label").distinct().count()
    rows = classes.orderBy(F.xxhash64("c")).limit(SAMPLE).select("e").collect()  # bounded: SAMPLE vectors
    sample = _unit(np.array([r["e"] for r in rows]))
    k = int(np.clip(np.sqrt(n / labels / PER_CELL), 1, max(1, len(sample) // PER_CENTROID)))
    index = MultiIndex(sample, k, threshold, TARGET_RECALL)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(np.array(b.column("e").flatten()).reshape(b.num_rows, -1))
            a, z = index.distances(x)
            home = a.argmin(1) * index.k + z.argmin(1)
            visits = [index.traverse(a[i], z[i]) for i in range(len(x))]
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [b.column("c"), b.column("label"), b.column("m"), pa.array(home, pa.int32()), pa.array(visits, pa.list_(pa.int32())), flat],
                ["c", "label", "m", "home", "visits", "x"],
            )

    placed = cut(classes.mapInArrow(assign, "c long, label string, m long, home int, visits array<int>, x array<double>"), "cells")
    asked = placed.select("c", "label", "m", "home", "visits", "x", F.explode("visits").alias("cell"))
    stored_n = placed.groupBy("label", F.col("home").alias("cell")).count().withColumn("sb", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    asked_n = placed.select("label", F.explode("visits").alias("cell")).groupBy("label", "cell").count().withColumn("qb", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    blocks = stored_n.join(asked_n, ["label", "cell"])
    # each query joins one query block and all stored blocks of the cell, each stored row one and all query blocks
    q = asked.join(blocks, ["label", "cell"]).select("*", F.pmod(F.xxhash64("c"), F.col("qb")).alias("q"), F.explode(F.sequence(F.lit(0), F.col("sb") - 1)).alias("s"), F.lit(True).alias("asks"))
    s = placed.withColumn("cell", F.col("home")).join(blocks, ["label", "cell"]).select("*", F.pmod(F.xxhash64("c"), F.col("sb")).alias("s"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), F.lit(False).alias("asks"))
    cols = ["label", "cell", "q", "s", "asks", "c", "m", "home", "visits", "x"]
    met = q.select(*[F.col(c).cast("long") if c in ("q", "s") else F.col(c) for c in cols]).unionByName(s.select(*[F.col(c).cast("long") if c in ("q", "s") else F.col(c) for c in cols]))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        q, s = g[g["asks"]], g[~g["asks"]]
        if q.empty or s.empty:
            return pd.DataFrame({"c": [], "n": [], "other": []})
        x, y = np.stack(q["x"].to_numpy()), np.stack(s["x"].to_numpy())
        qm, sm = q["m"].to_numpy(), s["m"].to_numpy()
        names, node = np.unique(np.concatenate((q["c"], s["c"])), return_inverse=True)
        qi, si = node[: len(q)], node[len(q) :]
        i, j = np.nonzero((x @ y.T >= threshold) & (qi[:, None] != si[None, :]))
        n = np.zeros(len(names), np.int64)
        np.add.at(n, qi[i], sm[j])
        # a stored row that won't ask for the query's cell is counted here too
        homes, h = np.unique(q["home"].to_numpy(), return_inverse=True)
        visits, owner = np.concatenate(s["visits"].to_numpy()), np.repeat(np.arange(len(s)), s["visits"].map(len))
        at = np.minimum(np.searchsorted(homes, visits), len(homes) - 1)
        asks = np.zeros((len(homes), len(s)), bool)
        own = homes[at] == visits
        asks[at[own], owner[own]] = True
        back = ~asks[h[i], j]
        np.add.at(n, si[j[back]], qm[i[back]])
        root = np.arange(len(names))
        asking, first = np.unique(i, return_index=True)
        for k, begin, end in zip(asking, first, np.append(first, len(i))[1:], strict=True):
            joined = np.unique(root[np.append(si[j[begin:end]], qi[k])])
            if len(joined) > 1:
                root[np.isin(root, joined)] = joined[0]
        hit = np.unique(np.concatenate((qi[i], si[j])))
        return pd.DataFrame({"c": names[hit], "n": n[hit], "other": names[root[hit]]})

    hits = cut(met.groupBy("label", "cell", "q", "s").applyInPandas(compare, "c long, n long, other long"), "hits")
    links = hits.groupBy("c").agg(F.sum("n").alias("n"))
    comp = components(hits.select(F.col("c").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "c")
    done = classes.select("c", "m", "label", "e").join(links, "c", "left").join(comp, "c", "left")
    return done.select(F.lit(True).alias("fit"), "label", "e", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "c").alias("component_id"))
