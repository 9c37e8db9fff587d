"""Plan windows of headers, the latest as of an instant, the freshest and the tightest."""

import datetime

from pyspark.sql import functions as F

from meterlake.operators import plans


def reply(provider, hour, five=None, seven=None, claim=None, status=None, reset="7"):
    h = {"5h-utilization": five, "7d-utilization": seven, "representative-claim": claim, "status": status, "5h-reset": reset}
    return provider, datetime.datetime(2024, 1, 1, hour), {plans.PREFIX + k: v for k, v in h.items() if v is not None}


def test_snapshots(spark):
    rows = [
        reply("anthropic", 1, " 0.5 ", "0.9", "seven_day", "throttled"), reply("anthropic", 2, "0.25", "x", "five_hour", reset="soon"), reply("anthropic", 3, None, "0.9"),
        reply("anthropic", 4, "much"), reply("openai", 5, "0.5"), reply("anthropic", 9, "0.75"),
    ]
    s = plans.snapshots(spark.createDataFrame(rows, "provider string, ts timestamp_ntz, headers map<string,string>"))
    got = [(r["captured_at"].hour, r["status"], [tuple(w) for w in r["windows"]]) for r in s.orderBy("captured_at").collect()]
    assert got == [(1, "throttled", [("7d", 0.9, 0), ("5h", 0.5, 7)]), (2, "allowed", [("5h", 0.25, 0), ("7d", 0.0, 0)]), (9, "allowed", [("5h", 0.75, 7), ("7d", 0.0, 0)])]
    at = lambda h, d=1: plans.latest(s, F.lit(datetime.datetime(2024, 1, d, h)))
    assert [(r["captured_at"].hour, r["age_s"], r["stale"]) for r in at(8).collect()] == [(2, 6 * 3600, False)]
    assert at(0).collect() == [] and [r["stale"] for r in at(21).collect()] == [False] and [r["stale"] for r in at(22).collect()] == [True]
    assert plans.freshest(at(22)).collect() == [] and plans.freshest(at(8)).first()["captured_at"].hour == 2
    both = s.withColumn("provider", F.when(F.hour("captured_at") == 1, "other").otherwise(F.col("provider")))
    assert tuple(plans.tightest(plans.latest(both, F.lit(datetime.datetime(2024, 1, 1, 8)))).first()) == ("other", "7d", 0.9)
    assert plans.tightest(at(0)).collect() == []
