"""Null ids, repeated rows and the pipeline."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from meterlake.llm import bpe, near_vectors, pii, quality_rules, queries
from tests.llm import brute
from tests.llm.test_queries import PASSAGE

ROWS = [(None, PASSAGE), (None, PASSAGE), (None, None), (3, PASSAGE), (3, PASSAGE), (4, f"new {PASSAGE} 4111 1111 1111 1111"), (4, f"new {PASSAGE} 4111 1111 1111 1111"), (9, PASSAGE * 60), (9, PASSAGE * 60), (8, PASSAGE * 60)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(d, t, None, "s", None) for d, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(None, "http://a.com/"), (None, None), (1, "http://a.com/"), (1, "http://a.com/")], "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(None, 1, 1), (1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    v = [float(i) for i in range(1, 9)]
    spark.createDataFrame([(None, v, 1), (None, v, 1), (1, v, 1), (1, v, 1), (2, v, 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


#: Centroids, the mix and the trie have rows of other kinds; test_round3.py has their null ids and repeats.
OWN_TESTS = ("op11_", "op12_", "op13_")


@pytest.mark.parametrize("name", sorted(q for q in queries.QUERIES if not q.startswith(OWN_TESTS)))
def test_null_ids_and_repeats(spark, odd, name):
    got = queries.QUERIES[name](spark, odd).collect()
    n = {"op5": 4, "op6": 5}.get(name.split("_")[0], len(ROWS))
    if name.startswith("op4"):
        assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
        assert sum(r["piece"] == 0 for r in got) == n
        return
    assert len(got) == n
    per_id = {}
    for r in got:
        if r[0] is not None:
            per_id.setdefault(r[0], set()).add(tuple(r))
    assert all(len(x) == 1 for x in per_id.values())
    if name.startswith("op1_"):
        tok = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
        want = brute.op1(ROWS, tok)
        assert all(tuple(r[1:4]) == want[r[0]] for r in got if r[0] is not None)
    if name.startswith("op8"):
        comp = {r["doc_id"]: r["component_id"] for r in got}
        assert comp == {None: None, 3: 3, 4: 3, 8: 3, 9: 3}
    if name.startswith("op10"):
        gone = {r["doc_id"]: r["n_removed"] for r in got}
        assert gone[None] == 0 and gone[3] == 0 and gone[4] == 70 and gone[8] > 0 and gone[9] == 60 * 69 + 1


@pytest.mark.parametrize("where", ["/root/testdata/sf0.001", "odd"])
def test_pipeline(spark, where, request):
    where = request.getfixturevalue("odd") if where == "odd" else where
    docs = spark.read.parquet(f"{where}/documents.parquet").selectExpr("*", "'x' as doc", "1 as n", "'r' as row")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, where)
        assert docs.columns[-3:] == ["doc", "n", "row"]
    docs.collect()
    got = {}
    for r in corpus_pipeline.run(spark, where).collect():
        got.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    t = pq.read_table(f"{where}/documents.parquet", columns=["doc_id", "text"])
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    judged = quality_rules.measure(spark.createDataFrame(rows, "doc_id long, text string")).select("row.text", "kept").collect()
    kept = {r["text"] for r in judged if r["kept"]}
    rows = [(d, x) for d, x in rows if x in kept]
    own = [(d, x) for d, x in rows if d is not None]
    classes = brute.op8(own)
    rows = [(d, x) for d, x in rows if d is None or classes[d][1] == d]
    left = brute.op10_kept([(d, x) for d, x in rows if d is not None])
    rows = [(d, x if d is None or left[d] is None else left[d]) for d, x in rows]
    model = pii.trained()
    texts = []
    for d, x in rows:
        base = pii.base_spans(x)
        texts.append((d, pii.replaced(x, pii.merged(base, pii.model_spans(model, [x])[0]))))
    want = {}
    tok = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    for d, x in texts:
        for k, v in brute.op4_pieces([(d, x)], tok).items():
            want.setdefault(k, []).append(v)
    assert got == want


def test_decode_by_itself(spark, odd):
    """`decode` of stored ids gives the texts that the encoding tasks decode."""
    path = queries.tokenizer_file("byte_bpe_50k.json")
    coded = bpe.encode(queries.documents(spark, odd), path, decoded=True)
    want = sorted((r["ids"], r["text"]) for r in coded.collect())
    got = sorted((r["ids"], r["text"]) for r in bpe.decode(coded.select("doc_id", "ids"), path).collect())
    assert got == want and len(got) == len(ROWS)


def test_pii_model_learns():
    model = pii.trained()
    held = pii.labelled(120, seed=99)
    found = pii.model_spans(model, [t for t, _ in held])
    hit = sum(len({*f} & {*s}) for f, (_, s) in zip(found, held, strict=True))
    assert hit >= 0.9 * sum(len(s) for _, s in held)
    assert sum(len({*f} - {*s}) for f, (_, s) in zip(found, held, strict=True)) <= 0.1 * hit


def test_pii_gradients():
    model = pii.Tagger(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = pii.training_set(pii.labelled(3, seed=5))
    x, y = x[:4], y[:4]
    _, g = model.step(x, y)
    for name in ("T", "O", "Uf", "Wb", "E", "cb"):
        flat, at = model.p[name].reshape(-1), int(np.abs(g[name]).argmax())
        was = flat[at]
        flat[at] = was + 1e-3
        up, _ = model.step(x, y)
        flat[at] = was - 1e-3
        down, _ = model.step(x, y)
        flat[at] = was
        assert abs((up - down) / 2e-3 - g[name].reshape(-1)[at]) < 0.02 * abs(g[name].reshape(-1)[at]) + 1e-3


def test_index_recall(spark):
    """Many cells: links found against all pairs."""
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 32))
    x = np.concatenate((x, x[:1500] + 0.17 * r.standard_normal((1500, 32))))
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    was = near_vectors.PER_CELL
    near_vectors.PER_CELL = 16
    try:
        got = {row["vec_id"]: row["n_links"] for row in near_vectors.near(df).collect()}
    finally:
        near_vectors.PER_CELL = was
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.97 * want.sum() > 500


def test_near_copies_of_many_leaders(spark):
    """Groups whose members link with some of each other only, so that the second pass must find links."""
    r = np.random.default_rng(8)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(120 + 60 * g)]
        for _ in range(40):
            w = list(base)
            for i in r.choice(len(w), r.integers(1, 1 + len(w) // 40), replace=False):
                w[i] = f"x{r.integers(1 << 40)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in queries.jaccard_join.classes(df).collect()}
    assert got == brute.op8(rows)
