"""Coverage of tools and members' periods over awkward rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from meterlake.operators import coverage, member_summary

D = datetime.datetime


@pytest.mark.parametrize(("text", "mode"), [
    ('{"tokens":{}}', "login"), ('{"tokens":{"a":1},"OPENAI_API_KEY":"k"}', "login"), ('{"tokens":null,"OPENAI_API_KEY":"k"}', "api_key"), ('{"tokens":[],"OPENAI_API_KEY":"k"}', "api_key"),
    ('{"OPENAI_API_KEY":""}', None), ('{"OPENAI_API_KEY":7}', None), ('{}', None), ("[]", None), ("no json", None), ("", None), (None, None),
])
def test_credential_mode(spark, text, mode):
    assert spark.createDataFrame([(text,)], "t string").select(coverage.credential_mode(F.col("t"))).first()[0] == mode


def test_tool_coverage(spark):
    login = '{"tokens":{}}'
    installed = [("a", "claude", None), ("a", "codex", login), ("a", "aider", None), ("a", "other", None), ("b", "codex", None), ("b", "codex", login), ("b", "claude", login), (None, "claude", None), ("c", "aider", None)]
    calls = [("a", "openai", D(2024, 1, 2, 0)), ("a", "anthropic", D(2024, 1, 1, 0)), ("b", "openai", D(2024, 1, 1, 12)), ("b", "anthropic", D(2024, 1, 1, 11, 59, 59)), ("b", "anthropic", None), (None, "anthropic", D(2024, 1, 2)), ("c", "anthropic", D(2024, 1, 2, 13))]
    got = coverage.tool_coverage(
        spark.createDataFrame(installed, "owner string, tool string, credentials string"), spark.createDataFrame(calls, "owner string, provider string, ts timestamp_ntz"), F.lit(D(2024, 1, 2, 12)).cast("timestamp_ntz")
    ).collect()
    assert sorted((str(r["owner"]), r["tool"], r["state"], r["since_s"]) for r in got if r["state"] == "protected") == [("a", "aider", "protected", 12 * 3600), ("b", "codex", "protected", 24 * 3600), ("c", "aider", "protected", 0)]
    assert sorted((str(r["owner"]), r["tool"], r["state"]) for r in got if r["state"] != "protected") == [
        ("None", "claude", "installed_not_seen"), ("a", "claude", "installed_not_seen"), ("a", "codex", "bypasses"), ("a", "other", "installed_not_seen"), ("b", "claude", "installed_not_seen"), ("b", "codex", "bypasses")]


@pytest.fixture(scope="module")
def events(spark):
    day = datetime.date
    rows = [
        (5, D(2024, 1, 1, 5), day(2024, 1, 1), "A@x", "m", "c", 100.0, 1), (4, D(2024, 1, 1, 5), day(2024, 1, 1), "a@x", "m", "c", 100.0, 2), (1, D(2024, 1, 3), day(2024, 1, 3), "a@x", None, None, 100.0, 3), (2, D(2024, 1, 3), day(2024, 1, 3), "a@x", "", None, None, 3),
        (3, D(2024, 1, 2), day(2024, 1, 2), "b@x", "m", "c", 0.0, 0), (6, D(2024, 1, 2), day(2024, 1, 2), None, "m", "c", 9.0, 0), (7, D(2024, 1, 9), day(2024, 1, 9), "a@x", "m", "c", 900.0, 0), (8, D(2024, 1, 4), day(2024, 1, 4), "c@x", "m", "c", 20000.0, 0),
    ]
    return spark.createDataFrame(rows, "id long, ts timestamp_ntz, day date, user_email string, model string, conversation_id string, charged_cents double, cache_read_tokens long")


def test_model_shares(events):
    got = sorted(tuple(r) for r in member_summary.model_shares(events, "2024-01-01", "2024-01-05").collect())
    assert got == [("a@x", 1, "m", 200.0, 2, 0.6667), ("a@x", 2, "unknown", 100.0, 2, 0.3333), ("b@x", 1, "m", 0.0, 1, 0.0), ("c@x", 1, "m", 20000.0, 1, 1.0)]


def test_top_prompts(events):
    got = sorted((r["user_email"], r["id"], r["cents"], r["cache_read_tokens"]) for r in member_summary.top_prompts(events, "2024-01-01", "2024-01-05").collect())
    assert got == [("a@x", 4, 100.0, 2), ("b@x", 3, 0.0, 0), ("c@x", 8, 20000.0, 0)]
    assert member_summary.top_prompts(events.limit(0), "2024-01-01", "2024-01-05").collect() == []


def test_limit_days(spark, events):
    members = spark.createDataFrame([("a@X", 3.0), ("a@x", 2.5), ("b@x", -1.0), (None, 1.0)], "email string, limit_dollars double")
    got = sorted(tuple(r) for r in member_summary.limit_days(events, members, "2024-01-01", "2024-01-05").collect())
    assert got == [("a@x", 300.0, 3.0, datetime.date(2024, 1, 3)), ("b@x", 0.0, 200.0, None), ("c@x", 20000.0, 200.0, datetime.date(2024, 1, 4))]


def test_notices(spark):
    at = lambda d: D(2024, 1, d)
    given = [(i, at(i), "*") for i in range(1, 9)] + [(10, at(7), "A@x"), (11, at(1), "a@x"), (12, None, "*"), (13, at(9), None), (14, at(9), "z@x"), (15, at(8), "*")]
    users = spark.createDataFrame([("a@x",), ("A@x",), ("b@x",), (None,)], "user_email string")
    got = member_summary.notices_for(users, spark.createDataFrame(given, "id long, created_at timestamp_ntz, target string"))
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == [(u, k + 1, i) for u, ids in (("a@x", [15, 8, 10, 7, 6]), ("b@x", [15, 8, 7, 6, 5])) for k, i in enumerate(ids)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
