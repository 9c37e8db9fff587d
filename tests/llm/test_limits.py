"""Limits of the operators: magnitudes, crowded tiles, windows without marks, ledgers of several runs."""

import numpy as np
import pytest

from meterlake.llm import jaccard_join, license_scan, near_vectors, packing, pii, secret_scan, substring_dedup
from tests.llm import brute


def test_vectors_of_extreme_size(spark):
    up, flat = [float(i) for i in range(1, 9)], [1.0] * 8
    rows = [up, up, [1e-200] * 8, [3e-200] * 8, [1e300] * 8, [2e300] * 8, flat, [x * 1e-300 for x in up], [1.0, 2.0], [1e200, 2e200], [2.0, -1.0]]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)] + [(None, up, 1)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near(df).collect()}
    assert {i: v[1] for i, v in got.items() if i is not None} == {0: 0, 1: 0, 7: 0, 2: 2, 3: 2, 4: 2, 5: 2, 6: 2, 8: 8, 9: 8, 10: 10}
    assert got[0][0] == 2 and got[2][0] == 4 and got[8][0] == 1 and got[None] == (0, None, True)


def test_windows_are_followed():
    model = pii.trained()
    texts = ["mail " + "k" * 90 + "é@mail.example.org now", "a" * 300 + "@" + "b" * 300, "", "+49 (0) 30 1234567 " * 20, "x" * 31 + "4111.1111.1111.1111" + "y" * 64]

    def every(text):
        k = np.arange(-1, (len(text) - 1) // pii.STRIDE + 1)
        if not len(text):
            return []
        return pii.join_labels(pii.reconcile(len(text), k, model.decode(pii.cut_windows(pii.codes(text), k * pii.STRIDE))), text)

    assert pii.model_spans(model, texts) == [every(t) for t in texts]


def test_licenses_of_null_and_shared_ids(spark):
    mit = "released under the terms of the mit license"
    rows = [(None, mit), (None, "nothing here"), (None, None), (1, mit), (1, "cc by nc"), (1, mit)]
    got = sorted((str(r["doc_id"]), r["labels"], r["score"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", "cc-by-nc", 1.0), ("1", "mit", 1.0), ("1", "mit", 1.0), ("None", "", 0.0), ("None", "", 0.0), ("None", "mit", 1.0)]


def test_license_threshold(spark):
    """Every share of every template's words, in several orders, against the plain rule."""
    r = np.random.default_rng(4)
    rows = []
    for label, wording in license_scan.TEMPLATES:
        own = sorted(set(wording.split()))
        for share in np.linspace(0.6, 1, 9):
            w = [*r.choice(own, max(1, round(share * len(own))), replace=False), *(f"z{i}" for i in range(r.integers(0, 9)))]
            rows.append((len(rows), " ".join(r.permutation(w))))
    got = {x["doc_id"]: x["labels"] for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    more = brute.op3_labels(rows, license_scan.TEMPLATES, license_scan.CONTAINMENT)
    base = brute.op3(rows)
    assert got == {d: ",".join(sorted({*filter(None, base[d][4].split(",")), *more.get(d, ())})) for d, _ in rows}


def test_ledger_of_two_runs(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    first = spark.createDataFrame([("a", "password = abcdefghijkl"), ("a", "clean"), ("b", "clean"), ("c", None)], "path string, text string")
    got = [tuple(r) for r in secret_scan.scan_into(first, path, key="path").select("path", "n_assign").collect()]
    assert sorted(got) == [("a", 0), ("a", 1), ("b", 0), ("c", 0)]
    assert spark.read.parquet(path).count() == 3  # a blob each
    ledger = spark.read.schema(secret_scan.FINDINGS).parquet(path)
    second = first.unionByName(spark.createDataFrame([("d", "clean"), ("e", "token: 0123456789abcdef")], "path string, text string"))
    fresh = secret_scan.update(second, ledger).collect()
    assert len(fresh) == 1 and fresh[0]["n_hex"] == 1
    twice = ledger.unionByName(ledger)
    found, known = secret_scan.scan(second, twice, key="path")
    assert found.count() == 6 and known.count() == 7
    got = [tuple(r) for r in secret_scan.scan_into(second, path, key="path").select("path", "n_assign", "n_hex").collect()]
    assert sorted(got) == [("a", 0, 0), ("a", 1, 0), ("b", 0, 0), ("c", 0, 0), ("d", 0, 0), ("e", 1, 1)]
    assert spark.read.parquet(path).count() == 4
    old = ledger.withColumn("rule_version", ledger.rule_version - 1)
    assert len(secret_scan.update(second, old).collect()) == 4  # another rule version has seen nothing


def test_crowded_tiles(spark, monkeypatch):
    """Tiles of many more members than a block, in blocks of few."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    r = np.random.default_rng(2)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for g in range(12):
        own = [f"g{g}w{i}" for i in range(60)]
        for _ in range(20):
            w = common + own
            for i in r.choice(60, r.integers(0, 4), replace=False) + 60:
                w[i] = f"x{r.integers(1 << 40)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    mixed = spark.createDataFrame([(1, d, d) for d, _ in rows], "tile long, doc long, component long")
    sig = jaccard_join.set_hashes(df).select("doc", "n", "bits")
    links = jaccard_join.connecting(mixed, sig, df.withColumnRenamed("doc_id", "doc"))
    got = brute.smallest_reachable([d for d, _ in rows], [(x["a"], x["b"]) for x in links.collect()])
    assert got == {d: c for d, (_, c) in brute.op8(rows).items()}
    assert links.count() < 20 * len(rows)


@pytest.mark.parametrize("size,least,most", [(1500, 300, 300), (1000, 150, 180)])
def test_merging_ends(spark, monkeypatch, size, least, most):
    """Where open sequences don't fit together merging stops; else it goes on over several levels."""
    monkeypatch.setattr(packing, "SHARD", 20)
    monkeypatch.setattr(packing, "FAN", 4)
    monkeypatch.setattr(packing, "pieces", lambda docs, *_: docs.selectExpr("doc_id as doc", "0 as piece", "0L as start", f"{size}L as length", "0L as ids_crc32"))
    got = packing.pack(spark.range(300).withColumnRenamed("id", "doc_id"), "").collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 300
    assert least <= len({r["sequence_id"] for r in got}) <= most


@pytest.mark.parametrize("hot", [2, 64, 4096])
def test_frequent_passages_beside_rare_ones(spark, monkeypatch, hot):
    """One passage in half of all documents, some in two, one repeated inside a text: no key, some keys or all keys are hot."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    r = np.random.default_rng(hot)
    words = lambda n: [f"w{x}" for x in r.integers(0, 10**6, n)]
    often, rare = words(53), [words(r.integers(48, 70)) for _ in range(12)]
    rows = []
    for i in range(200):
        parts = [words(r.integers(0, 40)), often if i % 2 else [], words(r.integers(0, 40)), rare[i // 8] if i % 8 < 2 and i < 96 else [], words(5)]
        rows.append((1000 - i, " ".join(sum(parts, []))))
    rows.append((7, " ".join(words(55) * 3)))
    got = {x["doc_id"]: x["kept"] for x in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.op10_kept(rows)
    assert {d: got[d] for d, x in want.items() if x is not None} == {d: x for d, x in want.items() if x is not None}
    assert len(got) == len(rows)


def test_tiles_and_texts_move_once(spark, monkeypatch):
    """Tiles take one exchange, a row for each slot of a batch; texts that aren't wanted stay where they are read."""
    r = np.random.default_rng(8)
    base = [[f"w{x}" for x in r.integers(0, 10**6, r.integers(6, 90))] for _ in range(60)]
    rows = [(i, " ".join([f"x{i}", *w])) for i, w in enumerate(base + base)] + [(i + 500, " ".join(base[0])) for i in range(40)] + [(900, ""), (901, None)]
    docs = spark.createDataFrame(rows, "doc long, text string").coalesce(1)
    met = jaccard_join.shared(jaccard_join.tiles(docs))
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    tiles = {}
    for x in met.collect():
        tiles.setdefault(x["tile"], set()).add(x["doc"])
    assert 500 in set().union(*tiles.values()) and not set(range(501, 540)) & set().union(*tiles.values())  # copies in a batch enter once
    linked = {(d, c) for d, (_, c) in brute.op8(rows).items() if c != d and not 500 < d < 540}
    assert linked and all(any({d, c} <= t for t in tiles.values()) for d, c in linked)

    wanted = spark.createDataFrame([(3,), (77,), (901,), (5000,)], "doc long")
    monkeypatch.setattr(jaccard_join, "MARKS", 128)  # most words hold several
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard_join.of(docs, wanted)
        assert sorted(tuple(x) for x in kept.collect()) == [(d, dict(rows)[d]) for d in (3, 77, 901)]
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join Inner") == 2 and "LeftSemi" not in plan  # a semi join would come before the bitmap's
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
