"""Replays, accumulation, syncs with overlap, and cache markers of bodies."""

import datetime
import json

from meterlake.operators import cache_hints
from meterlake.streaming import ingest

D = datetime.date


def test_replayed_batches(spark, tmp_path):
    path, days = f"file://{tmp_path}/out", [D(2024, 1, 1), D(2024, 1, 2)]
    batches = [[(days[0], 1.0), (days[0], -4.0), (days[1], float("nan")), (days[1], 2.5)], [(days[0], 0.5), (days[0], float("inf")), (days[0], None)], []]
    put = lambda i: ingest.put_batch(ingest.projected(spark.createDataFrame(batches[i], "day date, savings double")), path, i)
    totals = lambda: {r["day"]: r["savings"] for r in ingest.accumulated(spark, path).collect()}
    for i in (0, 1, 2):
        put(i)
    assert totals() == {days[0]: 1.5, days[1]: 2.5}
    put(1)
    put(0)
    assert totals() == {days[0]: 1.5, days[1]: 2.5}


def test_stream_of_batches(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(D(2024, 1, 1 + k % 2), float(k + 1)), (D(2024, 1, 1), 0.0)], "day date, savings double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    rows = spark.readStream.schema("day date, savings double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for name, accumulate in (("sums", True), ("rows", False)):
        for _ in range(2):  # the second run finds nothing new
            q = ingest.append_stream(rows, f"file://{tmp_path}/{name}", f"file://{tmp_path}/state-{name}", accumulate)
            assert q.awaitTermination(60)
    assert {r["day"]: r["savings"] for r in ingest.accumulated(spark, f"file://{tmp_path}/sums").collect()} == {D(2024, 1, 1): 4.0, D(2024, 1, 2): 2.0}
    assert spark.read.parquet(f"file://{tmp_path}/rows").count() == 6


def test_syncs(spark, tmp_path):
    path, schema = f"file://{tmp_path}/s", "day date, x int"
    rows = lambda *r: spark.createDataFrame([(D(2024, 1, d), x) for d, x in r], schema)
    now = lambda: sorted((r["day"].day, r["x"]) for r in ingest.synced(spark, path, schema).collect())
    assert ingest.next_start(spark, path, D(2024, 1, 1)) == D(2024, 1, 1)
    first = rows((1, 1), (2, 2), (3, 3), (9, 9))
    ingest.put_sync(first, path, 0, D(2024, 1, 1), D(2024, 1, 3))  # the ninth is not asked for
    assert now() == [(1, 1), (2, 2), (3, 3)] and ingest.next_start(spark, path, D(2024, 1, 1)) == D(2024, 1, 2)
    ingest.put_sync(rows((3, 30), (3, 31), (4, 4)), path, 1, D(2024, 1, 2), D(2024, 1, 5))
    assert now() == [(1, 1), (3, 30), (3, 31), (4, 4)]  # the second day is empty by now
    ingest.put_sync(rows((3, 30), (3, 31), (4, 4)), path, 1, D(2024, 1, 2), D(2024, 1, 5))
    ingest.put_sync(first, path, 0, D(2024, 1, 1), D(2024, 1, 3))
    assert now() == [(1, 1), (3, 30), (3, 31), (4, 4)]


BODIES = {
    "text": {"model": "claude-opus-4-8", "system": "sys", "messages": [{"role": "user", "content": "héllo"}, {"role": "user", "content": "not counted"}]},
    "blocks": {"model": "claude-opus-4-8", "system": [{"type": "text", "text": "ab"}, "cd", [{"text": "ef"}], {"image": 1}], "messages": [{"content": [{"type": "text", "text": 'q"uo\\te'}, {}]}]},
    "marked": {"model": "claude-opus-4-8", "system": "sys", "tools": [{"a": [{"cache_control": None}]}], "messages": []},
    "said": {"model": "claude-opus-4-8", "system": 'say {"cache_control": 1} or ,"cache_control":', "messages": [{"content": "cache_control"}], "x": ["cache_control", {"y": "cache_control"}]},
    "unknown": {"model": "who-knows", "system": "s", "messages": []}, "no model": {"system": "s"}, "nothing": {"model": "claude-opus-4-8", "messages": [{"content": []}], "system": 5}, "last": {"model": "gpt-5.5", "system": ["a"], "messages": [{"content": "b", "role": "user", "z": None}]},
}


def plain(body):
    """The body with markers, and its counted characters."""
    body, has = json.loads(json.dumps(body)), "cache_control"
    anywhere = lambda v: (has in v or any(map(anywhere, v.values()))) if isinstance(v, dict) else any(map(anywhere, v)) if isinstance(v, list) else False
    count = lambda v: len(v) if isinstance(v, str) else sum(map(count, v)) if isinstance(v, list) else len(v["text"]) if isinstance(v, dict) and isinstance(v.get("text"), str) else 0
    if anywhere(body):
        return body, False, 0
    first = (body.get("messages") or [{}])[0]
    n, done = count(body.get("system")) + count(first.get("content")), False
    for holder, key in ((body, "system"), (first, "content")):
        v = holder.get(key)
        if isinstance(v, str):
            holder[key], done = [{"type": "text", "text": v, has: {"type": "ephemeral"}}], True
        elif isinstance(v, list) and v and isinstance(v[-1], dict):
            v[-1][has], done = {"type": "ephemeral"}, True
    return body, done, n


def test_cache_markers(spark):
    rows = [(k, json.dumps(v)) for k, v in BODIES.items()] + [("bom", "﻿" + json.dumps(BODIES["text"])), ("bad", "not json"), ("null", None), ("list", "[1]")]
    df = spark.createDataFrame(rows, "name string, body string")
    got = {r["name"]: r for r in cache_hints.hinted(df).collect()}
    rate = {"claude-opus-4-8": 4.5, "gpt-5.5": 4.5}
    saved = {r["name"]: (r["characters"], r["savings"]) for r in cache_hints.foregone(df).collect()}
    for name, body in BODIES.items():
        want, done, n = plain(body)
        assert got[name]["modified"] == done and json.loads(got[name]["hinted"]) == want, name
        assert saved[name] == (n, round(n / 4 * rate.get(body.get("model"), 0) * 1000)), name
    assert json.loads(got["bom"]["hinted"]) == plain(BODIES["text"])[0] and saved["bom"] == saved["text"]
    assert all(got[k]["hinted"] == dict(rows)[k] and not got[k]["modified"] and saved[k] == (0, 0) for k in ("bad", "null", "list"))
