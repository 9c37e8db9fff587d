"""Unequal texts under one id, long lines, and texts with very many spans."""

import random
import time

from tokenizers import Tokenizer

from meterlake.llm import bpe, license_scan, pii
from meterlake.llm.queries import tokenizer_file
from tests.llm import brute


def test_ids_of_unequal_texts_under_one_id(spark):
    r = random.Random(5)
    a, b = (" ".join(f"w{r.randrange(9000)}" for _ in range(3000)) for _ in range(2))
    rows = [(1, a), (2, a), (2, b), (3, b), (3, None), (2, a), (None, b)]
    path = tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path, decoded=True).collect()
    want = [(d, b"".join(i.to_bytes(4, "little") for i in t.encode(x or "", add_special_tokens=False).ids), x or "") for d, x in rows]
    assert sorted((str(g["doc_id"]), bytes(g["ids"]), g["text"]) for g in got) == sorted((str(d), i, x) for d, i, x in want)


def test_licenses_in_long_lines(spark):
    far = [f"f{i}" for i in range(4000)]
    for i, w in enumerate("released under the terms of the mit license".split()):
        far[i * 500] = w
    near = " ".join(f"f{i}" for i in range(1777)) + " released under the terms of the mit license " + " ".join(f"g{i}" for i in range(2000))
    rows = [(1, " ".join(far)), (2, near), (3, near + "\n" + near), (4, " ".join(far) + "\nreleased under the terms\nof the mit license")]
    got = {x["doc_id"]: x["labels"] for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "mit", 3: "mit", 4: "mit"}
    assert {d: ",".join(sorted(v)) for d, v in brute.op3_labels(rows, license_scan.TEMPLATES, license_scan.CONTAINMENT).items()} == {2: "mit", 3: "mit", 4: "mit"}


def test_license_join_is_native(spark):
    plan = license_scan.scan(spark.createDataFrame([(1, "mit license")], "doc_id long, text string").filter("doc_id > 0"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ExistingRDD") <= 2  # the input itself, read twice


def test_merged_spans():
    r = random.Random(7)
    for _ in range(300):
        spans = lambda n: [(r.choice(pii.KINDS), a, a + r.randint(1, 12)) for a in (r.randrange(120) for _ in range(n))]
        base, more = spans(r.randrange(9)), spans(r.randrange(9))
        plain = [s for s in more if not any(a < s[2] and s[1] < b for _, a, b in base)]
        assert pii.merged(base, more) == sorted([*base, *plain], key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))


def test_many_spans_take_no_square():
    base, more = [("email", 40 * i, 40 * i + 20) for i in range(100_000)], [("phone", 40 * i + 22, 40 * i + 33) for i in range(100_000)]
    text = "ab@cd.example.org, " * 100_000
    start = time.perf_counter()
    assert len(pii.merged(base, more)) == 200_000
    assert len(pii.base_spans(text)) == 100_000
    assert time.perf_counter() - start < 20
