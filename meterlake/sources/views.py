"""Usage facts read from the driver's tables.

Each view is a projection written once as SQL text, integer and deterministic, that Spark and the
oracle both take, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-30"

_MODELS = ["claude-opus-4-8", "claude-sonnet-4-5-20250929", "claude-haiku-4-5[1m]", "gpt-5.5", "gpt-5.4-mini-2026-01", "gemini-2.5-flash-lite-preview", "gemini-2.5-pro", "unlisted-model"]


def _case(of: str, values: list[str]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_BLOCKED = "(event_type = 'error')"


def _unblocked(x: str) -> str:
    return f"CASE WHEN {_BLOCKED} THEN CAST(0 AS BIGINT) ELSE CAST({x} AS BIGINT) END"


REQUESTS = f"""SELECT event_id AS id, ts, CAST(ts AS DATE) AS day, {_case("CAST(event_id % 3 AS INT)", ["anthropic", "openai", "google"])} AS provider,
 {_case("CAST(event_id % 8 AS INT)", _MODELS)} AS model, {_unblocked("floor(value * 100)")} AS input_tokens,
 {_unblocked("event_id * 31 % 5000")} AS cache_creation_tokens, {_unblocked("event_id * 37 % 40000")} AS cache_read_tokens,
 {_unblocked("event_id * 13 % 2000")} AS output_tokens, {_BLOCKED} AS blocked,
 CASE WHEN user_id % 10 = 0 THEN NULL ELSE concat('s', CAST(user_id AS VARCHAR(20))) END AS session_id,
 CASE WHEN {_BLOCKED} THEN NULL ELSE event_id * 17 % 3000 END AS latency_ms,
 CASE CAST(event_id % 20 AS INT) WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 0 ELSE 200 END AS http_status,
 CASE WHEN event_id % 11 = 0 THEN 'bad' WHEN event_id % 7 = 0 THEN NULL ELSE concat(chr(123), '"team":"t', CAST(user_id % 5 AS VARCHAR(20)), '","k":"', CAST(event_id % 3 AS VARCHAR(20)), '"', chr(125)) END AS tags
 FROM events"""

ENTRIES = f"""SELECT event_id AS id, ts, CAST(ts AS DATE) AS day, {_case("CAST(user_id % 4 AS INT)", ["tool-a", "tool-b", "tool-c", "tool-d"])} AS tool,
 {_case("CAST(event_id % 8 AS INT)", _MODELS)} AS model, CAST(floor(value * 100) AS BIGINT) AS input_tokens,
 CAST(event_id * 31 % 5000 AS BIGINT) AS cache_creation_tokens, CAST(event_id * 7 % 900 AS BIGINT) AS cache_read_tokens,
 CAST(event_id * 13 % 2000 AS BIGINT) AS output_tokens, CAST(CASE WHEN event_id % 9 = 0 THEN event_id * 3 % 4000 ELSE 0 END AS BIGINT) AS reasoning_tokens,
 CASE WHEN user_id % 10 = 0 THEN NULL ELSE concat('s', CAST(user_id AS VARCHAR(20))) END AS session_id,
 {_case("CAST(user_id % 7 AS INT)", ["/w/app", "/w/app/api", "/w/site", "/x", "/w/application", "/W/App/Web"])} AS workspace,
 CAST(CASE WHEN event_id % 5 = 0 THEN 30000 ELSE 0 END AS BIGINT) AS context_window FROM events"""

TEAM = f"""SELECT event_id AS id, ts, CAST(ts AS DATE) AS day, concat('u', CAST(user_id AS VARCHAR(20))) AS user_email,
 concat({_case("CAST(event_id % 3 AS INT)", ["claude-4.6-opus", "gpt-5.4", "gemini-3.1-pro"])}, {_case("CAST(event_id % 4 AS INT)", ["", "-fast", "-xhigh", "-thinking"])}) AS model,
 CASE WHEN event_id % 13 = 0 THEN 'Free' ELSE 'Usage' END AS kind, concat(CAST(user_id AS VARCHAR(20)), '-', CAST(event_id % 6 AS VARCHAR(20))) AS conversation_id,
 CASE WHEN event_id % 13 = 0 THEN 0.0 ELSE value END AS charged_cents, CAST(floor(value * 100) AS BIGINT) AS input_tokens,
 CAST(event_id * 13 % 2000 AS BIGINT) AS output_tokens, CAST(event_id * 31 % 5000 AS BIGINT) AS cache_write_tokens, CAST(event_id * 37 % 40000 AS BIGINT) AS cache_read_tokens FROM events"""

#: Team events of which all uses up to the tenth were free.
FREE_START = TEAM.replace("CASE WHEN event_id % 13 = 0 THEN 'Free'", "CASE WHEN CAST(ts AS DATE) <= DATE '2024-01-10' AND event_id % 3 = 1 THEN 'Free'").replace("CASE WHEN event_id % 13 = 0 THEN 0.0", "CASE WHEN CAST(ts AS DATE) <= DATE '2024-01-10' AND event_id % 3 = 1 THEN 0.0")
#: Team events of which the fast ones cost three times as much.
FAST_DEARER = TEAM.replace("ELSE value END AS charged_cents", "ELSE value * CASE WHEN event_id % 4 = 1 THEN 3 ELSE 1 END END AS charged_cents")
#: Team events with several versions of a family.
TEAM_VERSIONS = TEAM.replace("gemini-3.1-pro", "claude-4.10-opus")

MEMBERS = """SELECT concat('u', CAST(c_custkey AS VARCHAR(20))) AS email, c_name AS name, CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS is_removed,
 CAST(50 + c_custkey % 200 AS DOUBLE) AS limit_dollars FROM customer"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, of: str = "events") -> DataFrame:
    return spark.sql(sql.replace(f"FROM {of}", "FROM {given}"), given=table(spark, sf_dir, of))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, REQUESTS)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ENTRIES)


def team_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TEAM)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, MEMBERS, "customer")
