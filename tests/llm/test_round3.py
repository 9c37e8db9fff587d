"""Centroid clustering, source mixing and the prefix trie against plain versions."""

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from meterlake.llm import exponion, prefix_trie, queries, source_mix
from tests.llm import brute

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
CLUSTER = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def listed(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("where", [SMALL, MORE])
def test_op11(spark, where):
    t = pq.read_table(f"{where}/embeddings.parquet")
    got = listed(queries.op11_exponion(spark, where), CLUSTER)
    want = [(i, j, d, a, b, s) for i, j, d, a, b, s in brute.op11(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True))]
    assert got == want


def test_op11_awkward(spark):
    """Ties, copies, repeated and null ids, vectors that don't count, large components, clashing columns."""
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.integers(0, 2, 64)]) for i in range(60)]  # many equal distances
    rows += [(i, rows[i][1]) for i in range(20)] + [(100 + i, rows[0][1]) for i in range(20)] + [(None, rows[3][1]), (None, rows[4][1])]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [None] * 64), (204, [float("nan")] * 64), (205, [float("inf")] * 64), (206, [1e6] * 64), (207, [-1e6 + 0.3] * 64), (208, [-0.001] * 64)]
    df = spark.createDataFrame([(*x, 1, 2.0) for x in rows], "vec_id long, embedding array<double>, cluster int, upper double")
    assert listed(exponion.report(df), CLUSTER) == brute.op11(rows)
    few = rows[:5]
    assert listed(exponion.report(spark.createDataFrame(few, "vec_id long, embedding array<double>")), CLUSTER) == brute.op11(few)
    one = rows[:1] * 3
    assert listed(exponion.report(spark.createDataFrame(one, "vec_id long, embedding array<double>")), CLUSTER) == brute.op11(one)
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], "vec_id long, embedding array<double>")
    assert [(x[0], x[2]) for x in listed(exponion.report(huge), CLUSTER)] == [(1, 0), (2, 0)]


def test_exponion_bounds():
    """The search finds the nearest of all, and looks at a part of them."""
    r = np.random.default_rng(2)
    centres = r.integers(-4000, 4000, (64, 8))
    x = centres[r.integers(0, 64, 4000)] + r.integers(-60, 60, (4000, 8))
    c, before = x[r.choice(len(x), 64, replace=False)].copy(), None
    a, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
    looked = []
    for _ in range(6):
        a, upper, lower, seen = exponion.Search(c, before).assign(x, a, upper, lower)
        looked.append(seen / (64 * len(x)))
        d = exponion.squared(x, c)
        assert (a == d.argmin(1)).all() and (upper + 1e-6 >= np.sqrt(d.min(1))).all()
        assert (lower <= np.sqrt(np.partition(d, 1, axis=1)[:, 1]) + 1e-6).all()
        before, c = c, np.array([x[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(64)])
    assert looked[-1] < 0.2 and max(looked[1:]) < 0.5


def check_mix(spark, df, rows, block=source_mix.BLOCK):
    got = source_mix.mix(df, block=block).collect()
    want = brute.op12_targets(rows)
    of = {d: s for d, _, s in rows}
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d), len(brute.WORD.findall(t or ""))) for d, t, _ in rows)
    taken = dict.fromkeys(want, 0)
    for r in got:
        s = of[r["doc_id"]]
        assert r["source_size"] == want[s][0] and abs(r["target"] - float(want[s][1])) <= 1e-9 * max(1, r["target"])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["taken"] > 0) == (r["first_slot"] is not None)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s][1]) <= 0.5 for s in want)
    again = source_mix.mix(df.repartition(5), block=block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.mark.parametrize("where", [SMALL, MORE])
def test_op12(spark, where):
    t = pq.read_table(f"{where}/documents.parquet", columns=["doc_id", "text", "source"])
    rows = list(zip(*(t[c].to_pylist() for c in ("doc_id", "text", "source")), strict=True))
    check_mix(spark, queries.documents(spark, where), rows)


def test_op12_awkward(spark):
    """Null and empty texts, null sources, sources without words, repeated rows and ids, one very long text."""
    rows = [(i, "w " * (i % 40), ["b", "a", None, "é", "z"][i % 5]) for i in range(300)]
    rows += [(1000, None, "a"), (1001, "", "none"), (1002, " \t\n", "none"), (1003, "long " * 500_000, "long"), (1004, "x y", "Z")]
    schema = "doc_id long, text string, source string, size int, rank string, taken long, k long"
    df = spark.createDataFrame([(*r, 1, "r", 2, 3) for r in rows], schema)
    check_mix(spark, df, rows, block=64)
    twice = [(7, "a b c", "s"), (7, "a b c", "s"), (7, "", "s"), (7, "", "s"), (None, "d e", None), (None, None, None)]
    got = source_mix.mix(spark.createDataFrame(twice, "doc_id long, text string, source string"), block=2).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == [("7", 0), ("7", 0), ("7", 3), ("7", 3), ("None", 0), ("None", 2)]
    assert source_mix.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_op12_schedule(spark):
    """Blocks of a source are read once each, in whole, and every stretch of slots holds sources by their shares."""
    rows = [(i, "w " * (20 + i % 7), "abc"[min(2, i // 500)]) for i in range(1500)]
    p = source_mix.pieces(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=100).filter("slot is not null").collect()
    words, of = {}, {d: s for d, _, s in rows}
    for r in p:
        words.setdefault(r["slot"], {}).setdefault(of[r["doc_id"]], []).append(r["n"])
    assert all(len(x) == 1 for x in words.values())
    per = {}
    for x in words.values():
        (s, n), = x.items()
        per.setdefault(s, []).append(sum(n))
    assert all(sorted(v)[1:] == [100] * (len(v) - 1) and max(v) <= 100 for v in per.values())
    order = [next(iter(words[s])) for s in sorted(words)]
    share = {s: len(v) / len(order) for s, v in per.items()}
    for at in range(0, len(order) - 60, 20):
        part = order[at : at + 60]
        assert all(abs(part.count(s) - 60 * share[s]) <= 4 for s in share)
    got = {}
    for r in p:
        got.setdefault((r["doc_id"], r["epoch"]), []).append((r["from_word"], r["n"]))
    for parts in got.values():  # consecutive, without gaps
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))


@pytest.mark.parametrize("where", [SMALL, MORE])
def test_op13(spark, where):
    t = pq.read_table(f"{where}/conversations.parquet")
    rows = list(zip(*(t[c].to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True))
    assert listed(queries.op13_prefix_trie(spark, where), NODE) == brute.op13(rows)


def odd_conversations():
    rows, r = [], np.random.default_rng(4)
    for c in [*range(0, 40), *range(100, 130), 205, 207, 211, 300, 305, *range(-120, -95), -5, 1000]:
        for n in range(r.integers(1, 9)):
            rows.append((c, n, "ua"[n % 2], f"t{n}" if r.random() < 0.8 else f"x{c}"))
    rows += [(0, None, None, None), (0, None, "u", "first"), (3, 2, "u", "tie"), (3, 2, "u", "tie"), (3, 2, None, "tié"), (None, 1, "u", "none"), (7, None, "u", None)]
    rows += [(400 + i, n, "u", f"same{n}") for i in range(60) for n in range(30)] + [(500, n, "u", f"same{n}") for n in range(45)]
    rows += [(600 + i, n, "u", "copy") for i in range(0, 40) for n in range(i + 1)] + [(700, n, "u", "é" * 50_000) for n in range(3)]
    return rows


@pytest.mark.parametrize("chunk", [6, 11, 4096])
@pytest.mark.parametrize("parts", [1, 40])
def test_op13_awkward(spark, chunk, parts):
    """Nulls, ties, absent and short bases, negative ids, copies, turnless conversations, and stretches of few turns."""
    rows = odd_conversations()
    df = spark.createDataFrame([(*x, 1, "b") for x in rows], "conv_id long, turn long, role string, text string, depth int, base string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = listed(prefix_trie.trie(df.repartition(7), chunk=chunk), NODE)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == brute.op13(rows)


def test_op13_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(empty).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "u", "x")], "conv_id long, turn long, role string, text string")).collect() == []


def test_op11_empty(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert exponion.report(df).collect() == []
    assert exponion.report(df.filter(F.lit(False))).collect() == []


@pytest.mark.parametrize("name", ["op11_exponion", "op12_source_mix", "op13_prefix_trie"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{MORE}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, MORE)
    assert sorted(df.columns) == sorted(columns) and listed(df, columns) == sorted(want.fetchall(), key=str)
