"""Decisions with feedback: the fold against a plain version, from stored totals, and as a stream; action signatures."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from meterlake.operators import actions
from meterlake.streaming import decisions
from meterlake.streaming.decisions import Ledger, Limits

SCHEMA = "owner string, id long, t long, session string, request string, action string, metered boolean, good boolean, nano long, fallback_nano long, violation string"
SECOND, HOUR = 1_000_000, 3_600_000_000


def call(ledger, limits, t, nano=10**9, session=None, request=None, action=None, metered=True, good=True, violation=None, cheaper=0):
    return ledger.decide(limits, t, session, request, action, metered, good, nano, cheaper, violation)


def test_order_of_checks():
    x = Ledger()
    limits = Limits(month=4, day=2, hour=1, session=1)
    assert call(x, limits, 0, session="s")[:2] == (False, None)
    assert call(x, limits, SECOND, session="s")[1] == "hourly_budget_exceeded"  # before the session's
    assert call(x, limits, SECOND, metered=False)[:2] == (False, None)  # a plan's call passes, and counts
    assert call(x, limits, 3 * HOUR)[1] == "budget_exceeded"
    assert call(x, limits, 24 * HOUR, session="s")[1] == "session_budget_exceeded"
    assert call(x, limits, 24 * HOUR, session="t")[0] is False
    assert call(x, limits, 26 * HOUR, metered=False)[0] is False
    assert call(x, limits, 26 * HOUR, violation="secret_detected")[1] == "secret_detected"
    assert call(x, limits, 26 * HOUR)[1:4] == ("monthly_budget_exceeded", False, 86_400 - 2 * 3600)
    assert call(x, limits, 31 * 24 * HOUR)[0] is False  # February


def test_refused_calls_do_not_count():
    x, limits = Ledger(), Limits(repeats=2, span=10)
    got = [call(x, limits, t * SECOND, request="r", nano=0)[0] for t in (0, 1, 2, 3, 10, 11, 12)]
    assert got == [False, False, True, True, True, False, False]
    x = Ledger()
    assert [call(x, limits, t, request="r", good=False)[0] for t in range(4)] == [False] * 4  # failures don't either
    x = Ledger()
    assert [call(x, Limits(actions=3, actions_enforce=True, repeats=99), t, request=f"r{t}", action="a")[1] for t in range(4)] == [None, None, "action_loop_detected", "action_loop_detected"]
    assert call(Ledger(), Limits(actions=1, actions_enforce=True), 0, action="a")[0] is False  # not without a request
    x, limits = Ledger(), Limits(spiral=1.5, spiral_enforce=True)
    assert [call(x, limits, t)[1] for t in range(3)] == [None, None, "cost_spiral"]


def test_cheaper_model_and_warning():
    x, limits = Ledger(), Limits(day=2, fallback=True)
    got = [call(x, limits, t, cheaper=10**8) for t in range(4)]
    assert [g[2] for g in got] == [False, False, True, True] and not any(g[0] for g in got)
    assert [g[4] for g in got] == ["ok", "ok", "exceeded", "exceeded"] and x.day_spent == 22 * 10**8
    x = Ledger()
    assert [call(x, Limits(day=10), t, nano=4 * 10**9)[4] for t in range(4)] == ["ok", "ok", "warn", "exceeded"]
    assert call(Ledger(), Limits(), 0)[4] == "off"


def made(n=400, seed=3):
    r, rows = random.Random(seed), []
    start = int(datetime.datetime(2024, 1, 30, 20, tzinfo=datetime.UTC).timestamp())
    for i in range(n):
        rows.append((r.choice(["a", "b", "c", None]), i, (start + r.randrange(12 * 3600)) * SECOND, r.choice(["s", "t", None]), r.choice(["x", "y", "z", None]), r.choice(["m", None, None]), r.random() < 0.8, r.random() < 0.9, r.choice([-5, 0, 10**7, 5 * 10**7]), 10**6, "secret" if r.random() < 0.02 else None))
    return rows


def plainly(rows, limits, stored=None):
    """Every decision from the list of all that was counted before."""
    out = []
    for owner in {r[0] for r in rows}:
        kept, seen = [], []  # (t, cost, session, request)
        if stored and owner in stored:
            day, spent, month = stored[owner]
            at = datetime.datetime.fromisoformat(day)
            kept = [(at, spent, None, None), (at.replace(year=1900), month - spent, None, at)]
        for r in sorted((r for r in rows if r[0] == owner), key=lambda r: (r[2], r[1])):
            now = datetime.datetime.fromtimestamp(r[2] / SECOND, datetime.UTC).replace(tzinfo=None)
            ago = lambda t, s: t >= now - datetime.timedelta(seconds=s)  # noqa: B023, E731
            month = sum(k[1] for k in kept if (k[3] if isinstance(k[3], datetime.datetime) else k[0]).timetuple()[:2] == now.timetuple()[:2])
            day = sum(k[1] for k in kept if k[0].date() == now.date())
            hour = sum(k[1] for k in kept if ago(k[0], 3600))
            session = sum(k[1] for k in kept if k[2] == r[3]) if r[3] else 0
            same = [k for k in kept if r[4] and k[3] == r[4] and ago(k[0], limits.span)]
            enforced = r[6] or limits.enforce_on_plan
            reason = r[10]
            for spent, cap, name in ((month, limits.month, "monthly_budget_exceeded"), (day, limits.day, "budget_exceeded"), (hour, limits.hour, "hourly_budget_exceeded"), (session, limits.session, "session_budget_exceeded")):
                if reason is None and enforced and cap and spent >= round(cap * 1e9):
                    reason = name
            if reason is None and len(same) >= limits.repeats:
                reason = "loop_detected"
            if reason is None and r[4] and r[5]:
                seen.append((now, r[5]))
                if sum(a == r[5] and ago(t, limits.span) for t, a in seen) >= limits.actions and limits.actions_enforce:
                    reason = "action_loop_detected"
            if reason is None and limits.spiral_enforce and sum(k[1] for k in kept if ago(k[0], limits.span)) > round(limits.spiral * 1e9):
                reason = "cost_spiral"
            if reason is None:
                kept.append((now, max(0, r[8]), r[3], r[4] if r[7] else None))
            out.append((r[1], reason is not None, reason))
    return sorted(out)


LIMITS = Limits(month=3, day=1.2, hour=0.2, session=0.5, span=1800, repeats=3, actions=4, actions_enforce=True, spiral=0.15, spiral_enforce=True)


def test_batch(spark):
    rows = made()
    got = decisions.decide(spark.createDataFrame(rows, SCHEMA).repartition(6), LIMITS).collect()
    assert sorted((r["id"], r["blocked"], r["reason"]) for r in got) == plainly(rows, LIMITS)
    assert {r["reason"] for r in got} >= {None, "secret", "hourly_budget_exceeded", "session_budget_exceeded", "loop_detected", "action_loop_detected", "cost_spiral"}
    assert decisions.decide(spark.createDataFrame([], SCHEMA), LIMITS).collect() == []


def test_from_stored_totals(spark):
    facts = [("a", "2024-01-30", 10**9), ("a", "2024-01-02", 10**9), ("a", "2023-12-31", 10**10), ("b", "2024-01-29", 2 * 10**9), ("b", "2024-01-31", 10**10)]
    df = spark.createDataFrame(facts, "owner string, day string, nano long").withColumn("day", F.col("day").cast("date"))
    stored = decisions.stored_totals(df, F.col("owner"), "2024-01-30")
    assert sorted((r["owner"], r["day_spent"], r["month_spent"]) for r in stored.collect()) == [("a", 10**9, 2 * 10**9), ("b", 0, 2 * 10**9)]
    rows = made()
    got = decisions.decide(spark.createDataFrame(rows, SCHEMA), LIMITS, stored).collect()
    assert sorted((r["id"], r["blocked"], r["reason"]) for r in got) == plainly(rows, LIMITS, {"a": ("2024-01-30", 10**9, 2 * 10**9), "b": ("2024-01-30", 0, 2 * 10**9)})


@pytest.mark.parametrize("hydrated", [False, True])
def test_stream_equals_batch(spark, tmp_path, hydrated):
    """Calls in order of time over five triggers, from stored totals too."""
    rows = sorted((r for r in made() if r[0] is not None), key=lambda r: (r[2], r[1]))
    for k in range(5):
        spark.createDataFrame(rows[k * len(rows) // 5 : (k + 1) * len(rows) // 5], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stored = None
    if hydrated:
        df = spark.createDataFrame([("a", "2024-01-30", 10**9), ("b", "2024-01-29", 2 * 10**9)], "owner string, day string, nano long").withColumn("day", F.col("day").cast("date"))
        stored = decisions.stored_totals(df, F.col("owner"), "2024-01-30")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = decisions.decision_stream(source, LIMITS, stored).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out")
    assert q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("id", "blocked", "reason", "retry_after", "day_status").collect())
    want = decisions.decide(spark.createDataFrame(rows, SCHEMA), LIMITS, stored)
    assert len(q.recentProgress) >= 5 and got == sorted(tuple(r) for r in want.select("id", "blocked", "reason", "retry_after", "day_status").collect())


def test_signatures(spark):
    args = '{"b": {"y": [1, {"q": 2, "p": null}], "x": "é"}, "a": 1.5}'
    same = '{"a":1.5,"b":{"x":"\\u00e9","y":[1,{"p":null,"q":2}]}}'
    escaped = same.replace("\\", "\\\\").replace('"', '\\"')
    bodies = [
        f'{{"messages":[{{"role":"assistant","content":[{{"type":"tool_use","name":"n","input":{args}}}]}}]}}',
        f'﻿{{"messages":[{{"role":"assistant","content":[{{"input":{same},"name":"n","type":"tool_use"}}]}},{{"role":"user","content":"go on"}}]}}',
        f'{{"messages":[{{"role":"assistant","content":null,"tool_calls":[{{"function":{{"name":"first","arguments":"x"}}}},{{"function":{{"name":"n","arguments":"{escaped}"}}}}]}}]}}',
        f'{{"contents":[{{"parts":[{{"functionCall":{{"name":"n","args":{same}}}}},{{"text":"t"}}]}},{{"role":"user","parts":[]}}]}}',
        '{"messages":[{"role":"assistant","tool_calls":[{"function":{"name":"n","arguments":"not json"}}]}]}',
        '{"messages":[{"role":"assistant","content":[{"type":"tool_use","name":"n","input":{"a":2}}]}]}',
        '{"messages":[{"role":"assistant","content":[{"type":"tool_use","name":"n","input":{}}]},{"role":"assistant","content":"text"}]}',
        '{"contents":[{"role":"model","parts":[{"functionCall":{"name":"n","args":{}}}]},{"role":"model","parts":[{"text":"t"}]}]}',
        "not json", "{}", "[]", None, '{"messages":{}}', '{"messages":[{"role":"assistant","tool_calls":[]}]}',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = [r["signature"] for r in actions.signed(df).orderBy("id").collect()]
    assert len(set(got[:4])) == 1 and got[0] and len({got[0], got[4], got[5]}) == 3
    assert got[4] and got[5] and got[6:] == [None] * 8
