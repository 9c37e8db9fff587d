"""Whole inputs, and steps whose work grows with their rows alone."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from meterlake.functions.labels import tags_of
from meterlake.operators import scan, windows
from meterlake.plans.ratecard import resolve
from meterlake.queries import ORACLES, QUERIES

START = datetime.datetime(2024, 1, 1)


def test_hosts_of_address_and_page(spark, tmp_path):
    rows = [(1, "http://A.example/x", '<a href="https://b.example/y">'), (2, None, "see ftp://c.example:21/"), (3, "https://d.example", None), (4, "://", "x"), (5, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in QUERIES["page_hosts"](spark, str(tmp_path)).collect())
    assert got == [(1, "a.example"), (1, "b.example"), (2, "c.example"), (3, "d.example")]
    assert got == sorted(duckdb.sql(ORACLES["page_hosts"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall())


@pytest.mark.parametrize("by", [[], ["k"]])
def test_dense_windows(spark, by):
    """Equal times, both borders, buckets apart and rows without a time; no frame slides."""
    rng = random.Random(3)
    rows = [(i, START + datetime.timedelta(seconds=10 * rng.randrange(90)), rng.choice(["a", None]), rng.randrange(50)) for i in range(300)]
    rows += [(i, START + datetime.timedelta(hours=i - 299), "a", i) for i in range(300, 303)] + [(303, None, "a", 5), (304, None, "a", 6)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, k string, v long")
    d = windows.in_window(df, F.col("v"), 300, *by)
    in_it = lambda a, b: (not by or a[2] == b[2]) and (b[1] is None if a[1] is None else b[1] is not None and datetime.timedelta(0) <= a[1] - b[1] <= datetime.timedelta(seconds=300))
    want = {a[0]: (sum(b[3] for b in rows if in_it(a, b)), sum(in_it(a, b) for b in rows)) for a in rows}
    assert {r["id"]: (r["windowed"], r["windowed_n"]) for r in d.collect()} == want
    assert "-300000000" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_tags_of_long_headers(spark):
    """Many pairs in a header: each is made once."""
    pairs = [(f"k{i % 7}" if i < 3000 else "late", f"v{i}") for i in range(4000)]
    df = spark.createDataFrame([(1, ",".join(f"{k.upper()} = {v}" for k, v in pairs)), (2, ",=,x"), (3, None)], "id int, header string").select("id", tags_of(F.col("header")).alias("t"))
    assert {r["id"]: r["t"] for r in df.collect()} == {1: {f"k{i}": f"v{i}" for i in range(6)}, 2: None, 3: None}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_rates_by_first_entry(spark):
    """Keys that begin with one another, hold marks of patterns or nothing; the plan has no branch for each entry."""
    models = ["gpt-5.5-pro", "gpt-5.5-pro-x", "gpt-5.5[1m]", "gpt-5.5", "gpt-5.5x", "gpt-5.5\n", "GPT-5.5", "a.b(", "axb(", "-x", "", None, "a.b(-1", "gpt-5.4-mini-x", "gpt-5.4-x"]
    over = [("a.b(", 7, 0, 0, 0), ("gpt-5.5", 8, 0, 0, 0), ("", 9, 0, 0, 0)]
    df = resolve(spark.createDataFrame([(m,) for m in models], "model string"), over)
    want = [8.0, 8.0, 8.0, 8.0, None, None, None, 7.0, None, 9.0, 9.0, None, 7.0, 0.75, 2.5]
    assert [(r["model"], r["rate_in"]) for r in df.collect()] == list(zip(models, want, strict=True))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("WHEN") == 0


def test_violations_searched_where_they_can_be(spark):
    """Marks at both ends of a text and of a segment; patterns are tried only on texts that hold their fixed parts."""
    texts = {
        "x;rm -rf /": "destructive", "rm -rf /": "destructive", "a\nrm\u2028 -rf /": None, "/ -rf rm\u2028;": "destructive", "farm -rf /": None, "mkfs": "destructive", "xmkfs": None,
        "DROP  table t": "destructive", "truncate": None, "no 123-45-6789": "ssn", "123-45-6789": "ssn", "1123-45-6789": None, "-123-45-6789": None, "900-45-6789": None, "666-45-6789": None,
        "x" + "\u200b" * 8: "hidden_text", "\U000e0041" * 8: "hidden_text", "\ufeff" * 8: "hidden_text", "\u2066" * 4 + "a" + "\u2060" * 4: "hidden_text", "\u201c" * 9: None,
        "AKIA" + "Q" * 16: "secret", "xAKIA" + "Q" * 16: None, "ghp_" + "a" * 36: "secret", "sk-" + "a" * 48: "secret", "": None,
    }
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").select("text", scan.first_violation(F.col("text"), exfil=False).alias("v"))
    assert {r["text"]: r["v"] for r in df.collect()} == {**texts, None: None}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"{part})" in plan for part in scan.HELD.values())
