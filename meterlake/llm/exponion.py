"""Operator 11, centroid clustering: k-means with exponion search.

Vectors become whole numbers, so distances and means are exact and results don't depend on the order of
rows.  Each vector carries its centroid, an upper bound of its distance to it and a lower bound of
its distance to any other.  When centroids move, bounds move with them.  A vector whose upper bound
is below its lower bound, or below half the way to its centroid's nearest neighbour, keeps its
centroid unseen; else its distance is computed anew, and if that doesn't settle it, it scans those centroids
only that lie in a ball around its own: within twice its distance plus the way to the nearest
neighbour, taken from that centroid's list of the others sorted by distance.  The nearest two
centroids are always inside.  The radius is inclusive and settling is strict, so a tie is always
scanned and goes to the smaller number.

A round is one pass over the vectors, which hold their state and are written to the shared folder,
and one sum for each centroid, combined before the shuffle.  The driver holds centroids only: `k` x `dims`.

Defined results: vectors that are null, of another length, or hold null or non-finite components are left out;
scaled components beyond ±2**27 count as that (so distances fit a long); with fewer vectors than `k`
each is a centroid; rows repeated under one id are vectors of their own, seeds too, ties by components; a
vector without id hashes as an empty id; sums beyond a long are null; an empty table gives no rows;
further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

K, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, "1"
#: Largest scaled component: 64 squared differences of twice that fit a long.
LARGEST = 1 << 27
#: Bounds are widened by this share, far more than they can err.
SLACK = 1e-9
STATE = "cluster int, upper double, lower double, distance long"


def integers(vectors: DataFrame, ident: str = "vec_id", column: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the vectors that count, x as whole numbers."""
    v = F.col(f"`{column}`")
    d = vectors.select(F.col(f"`{ident}`").alias("vec_id"), v.alias("v")).filter(F.size("v") == dims)
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("v", lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    return d.filter(sound).select("vec_id", whole.alias("x"))


def seeds(vectors: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The ``k`` vectors whose ids hash lowest, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(mark.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in first], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids (n x k), in whole numbers."""
    out = np.empty((len(x), len(c)), np.int64)
    for j, one in enumerate(c):
        diff = x - one
        out[:, j] = np.einsum("ij,ij->i", diff, diff)
    return out


class Search:
    """Centroids of a round, their distances to each other sorted, and how far they have moved."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None) -> None:
        self.c, k = centroids, len(centroids)
        gaps = np.sqrt(squared(centroids, centroids).astype(float))
        np.fill_diagonal(gaps, -1.0)  # oneself first
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, 1)
        self.gaps[:, 0] = 0.0
        self.nearest = self.gaps[:, 1] if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else np.sqrt(((centroids - before) ** 2).sum(1).astype(float))
        far = np.sort(self.moved)[::-1]
        # the farthest that any other centroid has moved
        self.others = np.where(self.moved == far[0], far[1] if k > 1 else 0.0, far[0])

    def assign(self, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Centroid and bounds of each row after this round; and how many distances to centroids were computed."""
        a, upper, lower = a.copy(), upper + self.moved[a], lower - self.others[a]
        half = np.maximum(lower, self.nearest[a] / 2) - SLACK * (1 + np.abs(lower) + self.nearest[a] + self.moved.max())
        open_ = np.flatnonzero(upper * (1 + SLACK) >= half)
        seen = len(open_)
        diff = x[open_] - self.c[a[open_]]
        upper[open_] = np.sqrt(np.einsum("ij,ij->i", diff, diff).astype(float))
        open_ = open_[upper[open_] * (1 + SLACK) >= half[open_]]
        radius = (2 * upper[open_] + self.nearest[a[open_]]) * (1 + SLACK)
        reach = np.empty(len(open_), np.int64)
        for j in np.unique(a[open_]):
            own = a[open_] == j
            reach[own] = np.searchsorted(self.gaps[j], radius[own], "right")
        at = a[open_] * (len(self.c) + 1) + reach
        for key in np.unique(at):
            own = open_[at == key]
            j, n = divmod(int(key), len(self.c) + 1)
            near = np.sort(self.order[j, :n])  # by number: the first of equals is the smallest
            d = squared(x[own], self.c[near])
            seen += d.size
            best = d.argmin(1)
            row = np.arange(len(own))
            upper[own] = np.sqrt(d[row, best].astype(float))
            a[own] = near[best]
            d[row, best] = np.iinfo(np.int64).max
            lower[own] = np.sqrt(d.min(1).astype(float)) if n > 1 else np.inf
        return a, upper, lower, seen


def _pass(vectors: DataFrame, search: Search, last: bool) -> DataFrame:
    """``vectors`` with their state after a round; before the first they have none.  Distances are told in the last."""
    fresh = "cluster" not in vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            lists = b.column("x")
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)
            state = (np.zeros(n), np.full(n, np.inf), np.zeros(n)) if fresh else (b.column(c).to_numpy() for c in ("cluster", "upper", "lower"))
            a, upper, lower = state
            a, upper, lower, _ = search.assign(x, a.astype(np.int64), upper, lower)
            dist = np.zeros(n, np.int64)
            if last:
                diff = x - search.c[a]
                dist = np.einsum("ij,ij->i", diff, diff)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), lists, pa.array(a, pa.int32()), pa.array(upper), pa.array(lower), pa.array(dist)], ["vec_id", "x", "cluster", "upper", "lower", "distance"])

    given = vectors.select("vec_id", "x") if fresh else vectors.select("vec_id", "x", "cluster", "upper", "lower")
    kind = dict(vectors.dtypes)["vec_id"]
    return given.mapInArrow(run, f"vec_id {kind}, x array<int>, {STATE}")


def means(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's mean, rounded down; one without vectors stays."""
    k, dims = centroids.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            a = b.column("cluster").to_numpy()
            for j in np.unique(a):
                n[j] += (a == j).sum()
                s[j] += x[a == j].sum(0, dtype=np.int64)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(s[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    own = assigned.select("x", "cluster").mapInArrow(summed, "cluster int, n long, s array<long>")
    each = own.select("cluster", "n", F.posexplode("s").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = centroids.copy()
    for r in each.collect():  # k x dims
        out[r["cluster"], r["at"]] = r["s"] // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, ident: str = "vec_id", column: str = "embedding", dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, cluster, distance) of each vector, and the final centroids (k x dims)."""
    d = cut(integers(vectors, ident, column, dims, scale), "integers")
    c = seeds(d, k, seed)
    if not len(c):
        kind = dict(d.dtypes)["vec_id"]
        return d.sparkSession.createDataFrame([], f"vec_id {kind}, x array<int>, cluster int, distance long"), c
    before = None
    for _ in range(rounds):
        d = cut(_pass(d, Search(c, before), False), "assigned")
        before, c = c, means(d, c)
    d = cut(_pass(d, Search(c, before), True), "assigned")
    return d.select("vec_id", "x", "cluster", "distance"), c


def report(vectors: DataFrame, **how) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector; parameters as for `cluster`."""
    d, c = cluster(vectors, **how)
    spark = d.sparkSession
    marks = spark.createDataFrame([(j, sha256(",".join(map(str, x)).encode()).hexdigest()) for j, x in enumerate(c.tolist())], "cluster int, centroid_sha256 string")
    own = d.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # `k` rows
    whole = sum(r["s"] for r in own)
    long = [(r["cluster"], *(int(s) if s < 1 << 63 else None for s in (r["s"], whole))) for r in own]
    sums = spark.createDataFrame(long, "cluster int, cluster_inertia long, inertia long")
    about = F.broadcast(marks.join(sums, "cluster"))  # `k` rows
    return d.join(about, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
