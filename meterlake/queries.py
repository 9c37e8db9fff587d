"""Registered queries of the usage engine, each with its oracle in SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import labels
from meterlake.operators import audit, payload, reports, scan, status, team, tools, waste, windows
from meterlake.plans.ratecard import CARD, card, priced
from meterlake.sources import views
from meterlake.sources.views import AS_OF, entries, members, requests, table, team_events
from meterlake.streaming import loops

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_CARD = "card AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for i, (k, a, b, c, d) in enumerate(CARD)) + ") t(ord, key, ri, rw, rr, ro))"
_COST = "(input_tokens * ri + cache_creation_tokens * rw + cache_read_tokens * rr + output_tokens * ro) / 1e6"
_NAIVE = "((input_tokens + cache_creation_tokens + cache_read_tokens) * ri + output_tokens * ro) / 1e6"
_PROMPT = "(input_tokens + cache_creation_tokens + cache_read_tokens)"
_TOKENS = "CAST(sum(input_tokens) AS BIGINT) input_tokens, CAST(sum(cache_creation_tokens) AS BIGINT) cache_creation_tokens, CAST(sum(cache_read_tokens) AS BIGINT) cache_read_tokens, CAST(sum(output_tokens) AS BIGINT) output_tokens"


def _usd(nano: str) -> str:
    return f"(floor(({nano} + 500) / 1000.0) / 1e6)"


def _nano(dollars: str) -> str:
    return f"CAST(round(coalesce({dollars}, 0) * 1e9) AS BIGINT)"


_USD = f"{_usd('coalesce(sum(nano), 0)')} cost_usd"


def _priced(name: str, of: str) -> str:
    return (
        f"{name}x AS (SELECT m.model, min(ord) ord FROM (SELECT DISTINCT model FROM {of}) m JOIN card ON m.model = key OR starts_with(m.model, key || '-') OR starts_with(m.model, key || '[') GROUP BY 1), "
        f"{name} AS (SELECT {of}.*, ri, rw, rr, ro, coalesce({_COST}, 0) cost_usd, {_nano(_COST)} nano FROM {of} LEFT JOIN {name}x USING (model) LEFT JOIN card USING (ord))"
    )


def _with(view: str, body: str, more: str = "") -> str:
    return f"WITH {_CARD}, f AS ({view}), {_priced('p', 'f')}{more} {body}"


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


R, E, T = views.REQUESTS, views.ENTRIES, views.TEAM
DAY = f"DATE '{AS_OF}'"


def on_day(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("day") == F.lit(AS_OF).cast("date"))


query("model_breakdown_day", _with(R, f"SELECT provider, model, {_USD}, count(*) n, {_TOKENS} FROM p WHERE NOT blocked AND day = {DAY} GROUP BY 1, 2"))(lambda s, d: reports.breakdown(on_day(requests(s, d)), "provider", "model"))
query("model_breakdown_since", _with(R, f"SELECT provider, model, {_USD}, count(*) n, {_TOKENS} FROM p WHERE NOT blocked AND day >= {DAY} - 6 GROUP BY 1, 2"))(lambda s, d: reports.breakdown(reports.since(requests(s, d), AS_OF, 7), "provider", "model"))
query("export_daily", _with(R, f"SELECT day, provider, model, {_USD}, count(*) n, {_TOKENS} FROM p WHERE NOT blocked GROUP BY 1, 2, 3"))(lambda s, d: reports.breakdown(requests(s, d), "day", "provider", "model").orderBy(F.desc("day"), "provider", "model"))
query("total_cost_day", _with(R, f"SELECT {_USD} FROM p WHERE day = {DAY}"))(lambda s, d: reports.total_cost(on_day(requests(s, d))))
query("total_cost_month", _with(R, f"SELECT {_USD} FROM p WHERE strftime(day, '%Y-%m') = '2024-01'"))(lambda s, d: reports.total_cost(requests(s, d).filter((F.col("day") >= "2024-01-01") & (F.col("day") < "2024-02-01"))))
query("daily_totals", _with(R, f"SELECT day, {_USD}, count(*) n, count(*) FILTER (blocked) blocked, round(CASE WHEN sum({_PROMPT}) > 0 THEN sum(cache_read_tokens) / sum({_PROMPT}) ELSE 0 END, 9) hit_rate FROM p GROUP BY 1"))(lambda s, d: reports.daily_totals(requests(s, d)))
query("session_costs", _with(R, f"SELECT session_id, {_USD}, count(*) n FROM p WHERE session_id IS NOT NULL AND day = {DAY} GROUP BY 1"))(lambda s, d: reports.session_costs(on_day(requests(s, d))))
query("provider_last_seen", f"SELECT provider, max(ts) last_seen FROM ({R}) GROUP BY 1")(lambda s, d: reports.last_seen(requests(s, d)))
query("daily_counts", f"SELECT day, count(*) requests, count(*) FILTER (blocked) blocked FROM ({R}) GROUP BY 1")(lambda s, d: reports.counts(requests(s, d)))
query("tag_rollup", _with(R, f", t AS (SELECT * FROM p WHERE starts_with(tags, chr(123))) SELECT tag, value, {_USD}, count(*) n FROM (SELECT 'team' tag, json_extract_string(tags, '$.team') AS value, nano FROM t UNION ALL SELECT 'k', json_extract_string(tags, '$.k'), nano FROM t) GROUP BY 1, 2"))(lambda s, d: reports.tag_rollup(requests(s, d)))
query("latency_metrics", f"SELECT provider, model, count(*) n, count(*) FILTER (http_status = 0 OR http_status >= 400) errors, quantile_disc(latency_ms, 0.5) p50, quantile_disc(latency_ms, 0.95) p95, round((count(*) FILTER (http_status = 0 OR http_status >= 400)) / count(*), 9) error_rate, round(count(*) / 7, 9) per_day FROM ({R}) WHERE latency_ms IS NOT NULL AND day >= {DAY} - 6 GROUP BY 1, 2")(lambda s, d: reports.latency_metrics(reports.since(requests(s, d), AS_OF, 7), 7))
query("tool_model_costs", f"WITH {_CARD}, f AS (SELECT tool, model, count(*) n, {_TOKENS} FROM ({E}) WHERE day = {DAY} GROUP BY 1, 2), {_priced('p', 'f')} SELECT tool, model, n, input_tokens, cache_creation_tokens, cache_read_tokens, output_tokens, {_usd('nano')} cost_usd FROM p")(lambda s, d: reports.tool_model(on_day(entries(s, d))))
query("workspace_rollup", _with(E, f"SELECT workspace, {_USD}, count(*) n FROM p GROUP BY 1"))(lambda s, d: reports.rollup(entries(s, d), "workspace"))
_ROOTS = ["/w", "/w/app", "/x/y"]
_UNDER = "(lower(workspace) = root OR starts_with(lower(workspace), root || '/'))"
query("repository_costs", _with(E, f", w AS (SELECT workspace, arg_max(root, length(root)) repo FROM (SELECT DISTINCT workspace FROM f), (VALUES ('/w'), ('/w/app'), ('/x/y')) r(root) WHERE {_UNDER} GROUP BY 1) SELECT day, coalesce(repo, workspace, '(none)') repo, coalesce(session_id, '(unknown)') AS session, model, {_USD}, count(*) turns FROM p LEFT JOIN w USING (workspace) GROUP BY 1, 2, 3, 4"))(lambda s, d: reports.by_repository(entries(s, d), _ROOTS))
query("wire_log_drift", f"WITH {_CARD}, f AS (SELECT * FROM ({R}) WHERE NOT blocked), g AS (SELECT * FROM ({E})), {_priced('p', 'f')}, {_priced('q', 'g')}, a AS (SELECT model, sum(nano) wire, count(*) wn FROM p GROUP BY 1), b AS (SELECT model, sum(nano) logs, count(*) ln FROM q GROUP BY 1), j AS (SELECT coalesce(a.model, b.model) model, coalesce(wire, 0) wire, coalesce(logs, 0) logs, coalesce(wn, 0) wire_n, coalesce(ln, 0) logs_n FROM a FULL JOIN b ON a.model = b.model) SELECT model, {_usd('wire')} wire, {_usd('logs')} logs, wire_n, logs_n, {_usd('(logs - wire)')} gap, round(CASE WHEN wire <> 0 THEN (logs - wire) / wire * 100 END, 6) gap_pct FROM j")(lambda s, d: reports.drift(requests(s, d), entries(s, d)))
_SUMMED = f"WITH {_CARD}, f AS (SELECT provider, model, {_TOKENS} FROM ({R}) WHERE NOT blocked GROUP BY 1, 2), {_priced('p', 'f')}, m AS (SELECT *, {_nano(_COST)} c, {_nano(_NAIVE)} w FROM p) "
query("cache_savings", _SUMMED + f"SELECT {_usd('sum(c)')} AS real, {_usd('sum(w)')} without_cache, {_usd('greatest(sum(w) - sum(c), 0)')} captured FROM m")(lambda s, d: reports.savings(requests(s, d)))
_SELDOM = f"WITH {_CARD}, f AS (SELECT tool AS provider, model, {_TOKENS} FROM ({E}) GROUP BY 1, 2), {_priced('p', 'f')}, m AS (SELECT *, {_nano(_COST)} c FROM p) "
query("cache_opportunities", _SELDOM + f"SELECT provider, model, {_usd('c')} cost_usd, round(cache_read_tokens / {_PROMPT} * 100, 6) share FROM m WHERE c >= 500000000 AND cache_read_tokens / {_PROMPT} * 100 < 30")(lambda s, d: reports.opportunities(entries(s, d).withColumn("provider", F.col("tool")).withColumn("blocked", F.lit(False))))
query("naive_overstatement", _SUMMED + f"SELECT provider, model, {_usd('c')} AS real, {_usd('w')} naive, {_usd('greatest(w - c, 0)')} overstated FROM m")(lambda s, d: reports.accuracy(requests(s, d)))
query("digest", _with(R, f"SELECT {_USD}, count(*) FILTER (NOT blocked) turns, count(*) FILTER (blocked) blocked, string_agg(DISTINCT model, ',' ORDER BY model) models FROM p"))(lambda s, d: reports.digest(requests(s, d)))
query("dense_days", _with(R, f", d AS (SELECT CAST({DAY} - CAST(i AS INTEGER) AS DATE) AS day FROM range(14) t(i)), c AS (SELECT d.day, coalesce(sum(nano), 0) c FROM d LEFT JOIN p USING (day) GROUP BY 1) SELECT day, {_usd('c')} cost_usd, {_usd('sum(c) OVER (ORDER BY day)')} running FROM c"))(lambda s, d: reports.dense_days(requests(s, d), AS_OF, 14))
query("month_burndown", _with(R, f"SELECT {_usd('coalesce(sum(nano), 0)')} spent, {_usd('coalesce(sum(nano), 0) / 30 * 31')} projected FROM p WHERE day <= {DAY} AND day >= DATE '2024-01-01'"))(lambda s, d: reports.burndown(requests(s, d), AS_OF))
query("latest_call", f"SELECT id, ts, provider, model FROM ({R}) WHERE NOT blocked ORDER BY ts DESC, id DESC LIMIT 1")(lambda s, d: reports.latest(requests(s, d)))
query("model_rates", f"WITH {_CARD}, f AS ({R}), x AS (SELECT m.model, min(ord) ord FROM (SELECT DISTINCT model FROM f) m LEFT JOIN card ON m.model = key OR starts_with(m.model, key || '-') OR starts_with(m.model, key || '[') GROUP BY 1) SELECT model, ri rate_in, rw rate_cw, rr rate_cr, ro rate_out FROM x LEFT JOIN card USING (ord)")(lambda s, d: priced(requests(s, d)).select("model", "rate_in", "rate_cw", "rate_cr", "rate_out").distinct())
query("model_labels", rf"SELECT DISTINCT model, CASE WHEN starts_with(x, 'claude-') THEN substr(x, 8) ELSE x END || tag AS label FROM (SELECT model, regexp_replace(regexp_replace(base, '-[0-9]{{8}}$', ''), '([0-9])-([0-9]+)$', '\1.\2') x, tag FROM (SELECT model, CASE WHEN ends_with(model, ']') THEN string_split(model, '[')[1] ELSE model END base, CASE WHEN ends_with(model, ']') THEN '[' || upper(string_split(model, '[')[2]) ELSE '' END tag FROM ({R})))")(lambda s, d: requests(s, d).select("model", reports.short_label(F.col("model")).alias("label")).distinct())

_SINCE = "2024-01-12 08:00:00"
_IN_APP = "(lower(workspace) = '/w/app' OR starts_with(lower(workspace), '/w/app/'))"
query("branch_attribution", _with(E, f"SELECT tool, model, {_USD}, count(*) turns FROM p WHERE {_IN_APP} AND ts >= TIMESTAMP '{_SINCE}' GROUP BY 1, 2"))(lambda s, d: status.attribution(entries(s, d), "/w/app", _SINCE))
query("branch_attribution_totals", _with(E, f"SELECT {_USD}, count(*) turns FROM p WHERE {_IN_APP} AND ts >= TIMESTAMP '{_SINCE}'"))(lambda s, d: status.attribution_totals(entries(s, d), "/w/app", _SINCE))
_TOOLS = {"tool-a": "anthropic", "tool-b": "openai", "tool-c": "not-proxied"}
query("combined_day", f"WITH {_CARD}, f AS (SELECT * FROM ({R}) WHERE day = {DAY}), g AS (SELECT tool, model, {_TOKENS} FROM ({E}) WHERE day = {DAY} GROUP BY 1, 2), {_priced('p', 'f')}, {_priced('q', 'g')}, l AS (SELECT nano FROM q WHERE NOT coalesce(CASE tool WHEN 'tool-a' THEN 'anthropic' WHEN 'tool-b' THEN 'openai' END IN (SELECT provider FROM p WHERE NOT blocked GROUP BY 1 HAVING sum(nano) > 0), false)) SELECT {_usd('(SELECT sum(nano) FROM p)')} proxied_usd, {_usd('(SELECT coalesce(sum(nano), 0) FROM l)')} logs_usd, {_usd('((SELECT sum(nano) FROM p) + (SELECT coalesce(sum(nano), 0) FROM l))')} cost_usd")(lambda s, d: status.combined_today(on_day(requests(s, d)), on_day(entries(s, d)), _TOOLS))
query("previous_day", _with(R, f"SELECT {_USD}, round(CASE WHEN sum({_PROMPT}) FILTER (NOT blocked) > 0 THEN sum(cache_read_tokens) FILTER (NOT blocked) / sum({_PROMPT}) FILTER (NOT blocked) * 100 ELSE 0 END, 9) hit_pct, count(*) FILTER (blocked) blocked FROM p WHERE day = {DAY} - 1"))(lambda s, d: status.previous_day(requests(s, d), AS_OF))
query("prior_window", _with(R, f", t AS (SELECT day, {_USD}, count(*) FILTER (blocked) blocked, round(CASE WHEN sum({_PROMPT}) > 0 THEN sum(cache_read_tokens) / sum({_PROMPT}) ELSE 0 END, 9) h FROM p WHERE day >= {DAY} - 13 AND day < {DAY} - 6 GROUP BY 1) SELECT round(sum(cost_usd), 6) cost_usd, round(avg(h) * 100, 6) hit_pct, CAST(sum(blocked) AS BIGINT) blocked FROM t"))(lambda s, d: status.prior_window(requests(s, d), AS_OF, 7))
query("hourly_average", _with(R, f"SELECT {_usd('coalesce(sum(nano), 0)')} spent, {_usd('floor(coalesce(sum(nano), 0) / 15.5)')} per_hour FROM p WHERE day = {DAY} AND ts <= TIMESTAMP '{AS_OF} 15:30:00'"))(lambda s, d: status.hourly_average(requests(s, d), f"{AS_OF} 15:30:00"))
query("live_sessions", f"SELECT session_id, id, model, prompt, ts < TIMESTAMP '{AS_OF} 12:00:00' - INTERVAL 1 HOUR idle FROM (SELECT *, {_PROMPT} prompt, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) k FROM ({R}) WHERE NOT blocked AND session_id IS NOT NULL) WHERE k = 1")(lambda s, d: status.last_call(requests(s, d), f"{AS_OF} 12:00:00"))
query("running_month_spend", _with(R, "SELECT id, CAST(sum(nano) OVER (PARTITION BY date_trunc('month', day) ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) spent FROM p"))(lambda s, d: windows.running(requests(s, d), "month"))
query("running_session_spend", _with(R, "SELECT id, session_id, CAST(sum(nano) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) spent FROM p WHERE session_id IS NOT NULL"))(lambda s, d: windows.running(requests(s, d), "session"))
_CONTEXT = "CASE " + " ".join(f"WHEN starts_with(model, '{k}') THEN {w}" for k, w in labels.CONTEXT_WINDOWS) + " END"
query("context_gauges", f"SELECT id, w AS context_window, pct, CASE WHEN pct < 60 THEN 'green' WHEN pct < 85 THEN 'yellow' ELSE 'red' END band FROM (SELECT id, CAST({_CONTEXT} AS BIGINT) w, CASE WHEN {_PROMPT} <= {_CONTEXT} THEN round({_PROMPT} / {_CONTEXT} * 100, 6) END pct FROM ({R}))")(lambda s, d: requests(s, d).select("id", labels.context_window(F.col("model")).alias("context_window"), F.round(labels.context_percent(F.col("model"), F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")), 6).alias("pct")).withColumn("band", labels.gauge_band(F.col("pct"))))
_HEADER = "concat(' Team = t', CAST(user_id % 5 AS VARCHAR(20)), ',bad,k!=', CAST(event_id % 3 AS VARCHAR(20)), ',team=dup,=x,e=,', CASE WHEN event_id % 2 = 0 THEN 'a=1,b=2,c=3,d=4,f=5' ELSE '' END)"
query("request_tags", """SELECT id, tag, value FROM (SELECT event_id AS id, unnest([struct_pack(tag := 'team', value := 't' || CAST(user_id % 5 AS VARCHAR)), struct_pack(tag := 'k', value := CAST(event_id % 3 AS VARCHAR))] || CASE WHEN event_id % 2 = 0 THEN [struct_pack(tag := 'a', value := '1'), struct_pack(tag := 'b', value := '2'), struct_pack(tag := 'c', value := '3'), struct_pack(tag := 'd', value := '4')] ELSE [] END, recursive := true) FROM events)""")(lambda s, d: views.view(s, d, f"SELECT event_id AS id, {_HEADER} AS header FROM events").select("id", F.explode(labels.tags_of(F.col("header"))).alias("tag", "value")))
query("billing_periods", f"SELECT day, strftime(CASE WHEN dayofmonth(day) < least(15, dayofmonth(last_day(day))) THEN date_trunc('month', day) - INTERVAL 1 MONTH ELSE date_trunc('month', day) END, '%Y-%m') AS period, count(*) n FROM ({R}) GROUP BY 1, 2")(lambda s, d: requests(s, d).groupBy("day", labels.period_of(F.col("day"), 15).alias("period")).agg(F.count("*").alias("n")))
query("seconds_to_midnight", f"SELECT id, CAST(greatest(1, 86400 - (hour(ts) * 3600 + minute(ts) * 60 + second(ts))) AS INTEGER) wait FROM ({R})")(lambda s, d: requests(s, d).select("id", labels.seconds_to_midnight(F.col("ts")).cast("int").alias("wait")))
query("trimmed_outputs", "SELECT doc_id, CASE WHEN length(text) > 2600 THEN left(text, 1200) || chr(10) || '… [' || CAST(length(text) - 2400 AS VARCHAR) || ' characters trimmed] …' || chr(10) || right(text, 1200) ELSE text END AS text FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", labels.trimmed_output(F.col("text")).alias("text")))

query("rolling_hour_spend", _with(R, f"SELECT id, {_usd('sum(nano) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)')} hour_usd FROM p"))(lambda s, d: windows.rolling_hour(requests(s, d)))
query("burn_rate", _with(R, f"SELECT id, {_usd('sum(nano) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND CURRENT ROW) * 60 / 15')} per_hour FROM p"))(lambda s, d: windows.burn_rate(requests(s, d)))
query("running_day_spend", _with(R, "SELECT id, CAST(sum(nano) OVER (PARTITION BY day ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) spent FROM p"))(lambda s, d: windows.running(requests(s, d)))
query("daily_budget_status", _with(R, f"SELECT day, spent, CASE WHEN spent >= 12 THEN 'exceeded' WHEN spent * 100 >= 12 * 80 THEN 'warn' ELSE 'ok' END AS status FROM (SELECT day, {_usd('sum(nano)')} spent FROM p GROUP BY 1)"))(lambda s, d: windows.daily_budget(requests(s, d), 12.0))
query("session_repeats", f"SELECT * FROM (SELECT id, session_id, count(*) OVER (PARTITION BY session_id ORDER BY ts RANGE BETWEEN INTERVAL 7200 SECOND PRECEDING AND CURRENT ROW) n FROM ({R}) WHERE session_id IS NOT NULL) WHERE n >= 3")(lambda s, d: windows.repeats(requests(s, d).filter("session_id is not null"), "session_id", span_s=7200, threshold=3))
query("cost_spirals", _with(R, f"SELECT * FROM (SELECT id, {_usd('sum(nano) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 300 SECOND PRECEDING AND CURRENT ROW)')} spent FROM p) WHERE spent > 0.25"))(lambda s, d: windows.spirals(requests(s, d), 0.25))
query("provider_changes", f"SELECT id, session_id, was, provider FROM (SELECT *, lag(provider) OVER (PARTITION BY session_id ORDER BY ts, id) was FROM ({R}) WHERE session_id IS NOT NULL) WHERE was <> provider")(lambda s, d: windows.changes(requests(s, d).filter("session_id is not null"), "session_id", "provider"))
query("first_model_use", f"SELECT model, id FROM (SELECT model, id, row_number() OVER (PARTITION BY model ORDER BY ts, id) k FROM ({R})) WHERE k = 1")(lambda s, d: windows.nth(requests(s, d), "model", 1))
query("drip_alerts", f"SELECT session_id, id FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) k FROM ({R}) WHERE session_id IS NOT NULL) WHERE k = 10")(lambda s, d: windows.nth(requests(s, d).filter("session_id is not null"), "session_id", 10))
query("exact_loops")(lambda s, d: loops.loops(requests(s, d), "session_id", 7200, 3))


def _cheap(prefix: str, key: str) -> str:
    r = next(x for x in CARD if x[0] == key)
    return f"WHEN starts_with(lower(model), '{prefix}') THEN (input_tokens * {r[1]} + cache_creation_tokens * {r[2]} + cache_read_tokens * {r[3]} + output_tokens * {r[4]}) / 1e6"


_WASTE = f""", w AS (
 SELECT 'cache-hit-starvation' AS rule, 'medium' severity, count(*) n, sum({_nano('input_tokens * greatest(ri - rr, 0) / 1e6')}) waste, sum(cache_read_tokens) / sum({_PROMPT}) < 0.1 AND count(*) >= 20 ok FROM p WHERE {_PROMPT} > 5000
 UNION ALL SELECT 'cache-dead-zone', 'medium', count(*), sum({_nano('cache_creation_tokens * greatest(rw - ri, 0) / 1e6')}), count(*) >= 20 AND sum(cache_creation_tokens) >= 20000 AND sum(cache_read_tokens) / sum(cache_creation_tokens) <= 0.05 FROM p WHERE cache_creation_tokens > 0
 UNION ALL SELECT 'model-overreliance', 'medium', count(*), sum({_nano('delta')}), count(*) >= 10 FROM (SELECT {_COST} - CASE {_cheap("claude-opus", "claude-haiku-4-5")} {_cheap("gpt-5.5", "gpt-5.4-mini")} END delta FROM p WHERE {_PROMPT} <= 2000 AND output_tokens <= 600) WHERE delta > 0
 UNION ALL SELECT 'reasoning-effort-overuse', 'medium', count(*), sum({_nano('c')}), count(*) >= 10 FROM (SELECT reasoning_tokens * ro / 1e6 c FROM p WHERE reasoning_tokens >= 1000 AND {_PROMPT} <= 2000) WHERE c > 0
 UNION ALL SELECT 'context-window-saturation', 'low', count(*), sum({_nano('input_tokens * ri / 1e6')}), count(*) >= 10 FROM p WHERE context_window > 0 AND {_PROMPT} / context_window >= 0.85
 UNION ALL SELECT 'runaway-context-growth', 'low', count(*), sum(w), count(*) > 0 FROM (SELECT session_id, sum({_nano('greatest(input_tokens - base, 0) * ri / 1e6')}) w FROM (SELECT *, avg(CASE WHEN k <= third THEN {_PROMPT} END) OVER s e, avg(CASE WHEN k > turns - third THEN {_PROMPT} END) OVER s l, avg(CASE WHEN k <= third THEN input_tokens END) OVER s base FROM (SELECT *, greatest(turns // 3, 1) third FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) k, count(*) OVER (PARTITION BY session_id) turns FROM p WHERE session_id IS NOT NULL) WHERE turns >= 8) WINDOW s AS (PARTITION BY session_id)) WHERE e > 0 AND l >= 3 * e GROUP BY 1) WHERE w > 0
 UNION ALL SELECT 'mega-sessions', 'low', count(*), 0, count(*) > 0 FROM (SELECT session_id FROM p WHERE session_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 40 AND sum({_PROMPT}) >= 500000)),
 found AS (SELECT rule, severity, n, coalesce(waste, 0) waste FROM w WHERE ok AND (waste > 0 OR rule = 'mega-sessions'))"""
query("waste_findings", _with(E, f" SELECT rule, severity, n, {_usd('waste')} waste_usd FROM found", _WASTE))(lambda s, d: waste.findings(entries(s, d)))
query("waste_headline", _with(E, f" SELECT {_usd('least((SELECT coalesce(sum(waste), 0) FROM found), (SELECT sum(nano) FROM p))')} waste_usd", _WASTE))(lambda s, d: waste.headline(entries(s, d)))

_FAMILY = "regexp_replace(model, '(-thinking)?(-(low|medium|high|xhigh|max))?(-thinking)?(-fast)?$', '')"
_PERIOD = "day >= DATE '2024-01-10' AND day < DATE '2024-01-25'"
_START, _END = "2024-01-10", "2024-01-25"
query("team_overview", f"WITH c AS (SELECT user_email email, sum(charged_cents) c, count(*) n FROM ({T}) WHERE {_PERIOD} GROUP BY 1), s AS (SELECT email, round(coalesce(c, 0) / 100, 6) spent, coalesce(n, 0) prompts, round(round(coalesce(c, 0) / 100, 6) / 10 * 15, 6) projected, limit_dollars l FROM ({views.MEMBERS}) LEFT JOIN c USING (email) WHERE is_removed = 0) SELECT email, spent, prompts, projected, CASE WHEN spent >= l THEN 'over_limit' WHEN projected >= l THEN 'over_pace' WHEN projected >= 0.8 * l THEN 'watch' ELSE 'ok' END AS status FROM s")(lambda s, d: team.overview(team_events(s, d), members(s, d), _START, _END, 10.0, 15))
query("team_median_prompt", f"SELECT round(median(c / n), 6) cents FROM (SELECT user_email, sum(charged_cents) c, count(*) n FROM ({T}) WHERE {_PERIOD} GROUP BY 1 HAVING count(*) >= 5)")(lambda s, d: team.median_per_prompt(team_events(s, d), _START, _END))
query("team_daily_series", f"WITH e AS (SELECT * FROM ({T}) WHERE {_PERIOD}), d AS (SELECT user_email, CAST(DATE '2024-01-10' + CAST(i AS INTEGER) AS DATE) AS day FROM (SELECT DISTINCT user_email FROM e), range(15) t(i)), s AS (SELECT user_email, day, coalesce(sum(charged_cents), 0) c FROM d LEFT JOIN e USING (user_email, day) GROUP BY 1, 2) SELECT user_email, day, round(c, 6) cents, round(sum(c) OVER (PARTITION BY user_email ORDER BY day), 6) running FROM s")(lambda s, d: team.daily_series(team_events(s, d), _START, _END))
query("team_top_chats", f"WITH e AS ({T}), s AS (SELECT user_email, conversation_id, round(sum(charged_cents), 6) cents FROM e WHERE {_PERIOD} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_email ORDER BY cents DESC, conversation_id) AS rank FROM s), a AS (SELECT conversation_id, min(ts) first_ts, max(ts) last_ts, count(*) n FROM e GROUP BY 1) SELECT user_email, conversation_id, cents, rank, first_ts, last_ts, n FROM r JOIN a USING (conversation_id) WHERE rank <= 5")(lambda s, d: team.top_chats(team_events(s, d), _START, _END))
query("team_families", f"SELECT {_FAMILY} AS family, contains(model, '-fast') AS fast, round(sum(charged_cents), 6) cents, count(*) n FROM ({T}) GROUP BY 1, 2")(lambda s, d: team.by_family(team_events(s, d)))
query("team_free_use", f"SELECT model, min(ts) first_ts, count(*) n, count(*) FILTER (kind = 'Free') free, round((count(*) FILTER (kind = 'Free')) / count(*), 9) AS share FROM ({T}) GROUP BY 1")(lambda s, d: team.free_use(team_events(s, d)))
query("team_week_per_prompt", f"SELECT user_email, round(sum(charged_cents) / count(*), 6) cents, count(*) n FROM ({T}) WHERE day >= {DAY} - 7 AND day < {DAY} GROUP BY 1")(lambda s, d: team.week_per_prompt(team_events(s, d), AS_OF))
query("team_fit_windows", f"SELECT model, CAST(CASE WHEN a >= 100 THEN 7 WHEN b >= 100 THEN 14 ELSE 30 END AS INTEGER) AS days, CASE WHEN a >= 100 THEN a WHEN b >= 100 THEN b ELSE n END n FROM (SELECT model, count(*) FILTER (day >= {DAY} - 7) a, count(*) FILTER (day >= {DAY} - 14) b, count(*) n FROM ({T}) WHERE charged_cents > 0 AND day >= {DAY} - 30 AND day < {DAY} GROUP BY 1)")(lambda s, d: team.fit_windows(team_events(s, d), AS_OF))
query("team_family_moments", f"SELECT {_FAMILY} AS family, ends_with(model, '-fast') AS fast, count(*) n, round(sum(input_tokens / 1e6), 6) x0, round(sum(output_tokens / 1e6), 6) x1, round(sum(input_tokens / 1e6 * (output_tokens / 1e6)), 6) xx01 FROM ({T}) WHERE charged_cents > 0 GROUP BY 1, 2")(lambda s, d: team.family_moments(team.moments(team_events(s, d))).select("family", "fast", "n", *[F.round(c, 6).alias(c) for c in ("x0", "x1", "xx01")]))
query("team_charge_split")(lambda s, d: team.charge_split(team.between(team_events(s, d), _START, _END), team.rates(team_events(s, d), AS_OF), "user_email"))
query("team_fast_what_if")(lambda s, d: team.fast_what_if(team.between(views.view(s, d, views.FAST_DEARER), _START, _END), team.rates(views.view(s, d, views.FAST_DEARER), AS_OF)))
query("team_free_periods", f"WITH e AS (SELECT *, {_FAMILY} AS family FROM ({views.FREE_START})), l AS (SELECT family, max(ts) last_free FROM e WHERE kind = 'Free' GROUP BY 1) SELECT family, last_free FROM e JOIN l USING (family) GROUP BY 1, 2 HAVING count(*) FILTER (ts > last_free AND charged_cents > 0) > 0 AND count(*) FILTER (kind = 'Free' AND ts <= last_free) >= 50 AND count(*) FILTER (kind = 'Free' AND ts <= last_free) >= 0.8 * count(*) FILTER (ts <= last_free)")(lambda s, d: team.free_periods(views.view(s, d, views.FREE_START)))
_VERSION = "list_transform(string_split(regexp_extract(family, '[0-9]+([.][0-9]+)*'), '.'), lambda x: CAST(x AS INTEGER))"
query("team_newest_families", f"WITH e AS (SELECT {_FAMILY} AS family, count(*) n FROM ({views.TEAM_VERSIONS}) WHERE day >= {DAY} - 14 AND day < {DAY} GROUP BY 1), v AS (SELECT *, {_VERSION} v, trim(replace(regexp_replace(family, '-?[0-9]+([.][0-9]+)*', ''), '--', '-'), '-') stem FROM e), b AS (SELECT stem, arg_max(family, v) newest, max(v) top FROM v WHERE n >= 20 GROUP BY 1) SELECT family, newest FROM v JOIN b USING (stem) WHERE v < top")(lambda s, d: team.newest_families(views.view(s, d, views.TEAM_VERSIONS), AS_OF))
query("team_restart_excess", f"SELECT user_email, round(sum(CASE WHEN k > 5 THEN greatest(charged_cents - base, 0) ELSE 0 END), 4) cents FROM (SELECT *, avg(CASE WHEN k <= 5 THEN charged_cents END) OVER (PARTITION BY user_email, conversation_id) base FROM (SELECT *, row_number() OVER (PARTITION BY user_email, conversation_id ORDER BY ts, id) k FROM ({T}))) GROUP BY 1")(lambda s, d: team.restart_excess(team_events(s, d)))
_X = [f"({c} / 1e6)" for c in team.COLS]
query(
    "team_rate_moments",
    "SELECT model, count(*) n, round(sum(charged_cents / 100 * charged_cents / 100), 6) yy, " + ", ".join([f"round(sum({_X[i]} * {_X[j]}), 6) xx{i}{j}" for i in range(4) for j in range(i, 4)] + [f"round(sum({_X[i]} * charged_cents / 100), 6) xy{i}" for i in range(4)] + [f"round(sum({_X[i]}), 6) x{i}" for i in range(4)]) + f" FROM ({T}) WHERE charged_cents > 0 GROUP BY 1",
)(lambda s, d: team.moments(team_events(s, d)).select("model", "n", *[F.round(c, 6).alias(c) for c in ["yy", *[f"xx{i}{j}" for i in range(4) for j in range(i, 4)], *[f"xy{i}" for i in range(4)], *[f"x{i}" for i in range(4)]]]))
query("team_fitted_rates")(lambda s, d: team.fitted_rates(team_events(s, d)))

_HASH = "sha256(concat_ws(chr(10), 'requests', CAST(id AS VARCHAR), CASE WHEN blocked THEN 'block' ELSE 'forward' END, provider, model, CAST(input_tokens AS VARCHAR), CAST(output_tokens AS VARCHAR)))"
query("audit_contents", f"SELECT day, id, {_HASH} content_hash FROM ({R})")(lambda s, d: audit.contents(requests(s, d)))
query("audit_chain", f"WITH RECURSIVE c AS (SELECT day, id, {_HASH} content_hash, row_number() OVER (PARTITION BY day ORDER BY id) - 1 AS seq FROM ({R})), k AS (SELECT day, seq, id, content_hash, sha256(CAST(day AS VARCHAR)) prev_hash, sha256(sha256(CAST(day AS VARCHAR)) || chr(10) || content_hash) AS hash FROM c WHERE seq = 0 UNION ALL SELECT c.day, c.seq, c.id, c.content_hash, k.hash, sha256(k.hash || chr(10) || c.content_hash) FROM k JOIN c ON c.day = k.day AND c.seq = k.seq + 1) SELECT * FROM k")(lambda s, d: audit.seal(audit.contents(requests(s, d))))
_TXT = "regexp_extract_all(text, '[0-9](?:[ -]?[0-9]){12,18}')"
query("card_numbers", f"WITH runs AS (SELECT doc_id, i, regexp_replace(unnest({_TXT}), '[ -]', '', 'g') x FROM documents, (SELECT 0 i)) SELECT doc_id, count(*) n FROM (SELECT doc_id, x, list_sum(list_transform(range(length(x)), lambda k: CASE WHEN k % 2 = 0 THEN CAST(x[length(x) - k] AS INT) ELSE (2 * CAST(x[length(x) - k] AS INT)) - CASE WHEN CAST(x[length(x) - k] AS INT) > 4 THEN 9 ELSE 0 END END)) t FROM runs WHERE length(x) BETWEEN 13 AND 19 AND x[1] IN ('3', '4', '5', '6')) WHERE t % 10 = 0 GROUP BY 1")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.size(scan.card_numbers(F.col("text"))).cast("long").alias("n")).filter("n > 0")
)
query("denied_commands", "SELECT conv_id, turn FROM conversations WHERE contains(regexp_replace(lower(text), '\\s+', ' ', 'g'), 'of the')")(lambda s, d: table(s, d, "conversations").filter(scan.command_denied(F.col("text"), ["OF  the"])).select("conv_id", "turn"))
query("page_hosts", "SELECT DISTINCT page_id, lower(unnest(regexp_extract_all(concat_ws(' ', url, html), '://([^/:\"\\\\\\s]+)', 1))) AS host FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", F.explode(scan.hosts(F.concat_ws(" ", "url", "html"))).alias("host")))
query("payload_violations")(lambda s, d: table(s, d, "documents").select("doc_id", scan.first_violation(F.col("text"), scan.DENY_PATHS, scan.DENY_COMMANDS, exfil=False).alias("violation")).filter("violation is not null"))
#: Documents of which some end with a key, hidden characters or a number like a person's.
_ENDED = f"SELECT doc_id, concat(text, CASE WHEN doc_id % 9 = 0 THEN concat(chr(10), 'key AKIA', repeat('Q', 16)) WHEN doc_id % 11 = 0 THEN concat(chr(10), 'a{chr(8203)}b') WHEN doc_id % 13 = 0 THEN concat(chr(10), 'no. ', CAST(doc_id % 3 AS VARCHAR(20)), '12-', CASE WHEN doc_id % 5 = 0 THEN '00' ELSE '34' END, '-5678.') ELSE '' END) AS text FROM documents"
query("file_findings", f"SELECT CAST(doc_id AS VARCHAR) path, CAST(len(string_split(text, chr(10))) AS INTEGER) line, CASE WHEN doc_id % 9 = 0 THEN 'aws' ELSE 'hidden_text' END AS rule, CASE WHEN doc_id % 9 = 0 THEN 'error' ELSE 'warning' END AS level FROM ({_ENDED}) WHERE text IS NOT NULL AND (doc_id % 9 = 0 OR doc_id % 11 = 0)")(lambda s, d: scan.scan_lines(views.view(s, d, _ENDED, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")))
query("ssn_documents", rf"SELECT doc_id FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^0-9-])([0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}})(?:[^0-9-]|$)', 1)) x FROM ({_ENDED})) WHERE x[1:3] NOT IN ('000', '666') AND x[1] <> '9' AND x[5:6] <> '00' AND x[8:11] <> '0000'")(lambda s, d: views.view(s, d, _ENDED, "documents").filter(scan.has_ssn(F.col("text"))).select("doc_id"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request body of each turn of a conversation: a call of a shell that holds the turn's text."""
    call = F.struct(F.lit("tool_use").alias("type"), F.lit("bash").alias("name"), F.struct(F.col("text").alias("command")).alias("input"))
    turn = F.struct(F.col("role"), F.array(call).alias("content"))
    return table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.to_json(F.struct(F.array(turn).alias("messages"))).alias("body"))


query("tool_argument_scopes", "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'args' ELSE 'history' END AS scope, CASE WHEN role = 'assistant' THEN 'bash' END tool, length(text) AS size FROM conversations WHERE text IS NOT NULL")(lambda s, d: payload.leaves(bodies(s, d)).filter("slot = 'command'").select("id.conv_id", "id.turn", "scope", F.when(F.col("scope") == "args", F.col("tool")).alias("tool"), F.length("text").cast("long").alias("size")))
_DENIED = " OR ".join(f"contains(lower(text), '{p.lstrip('~')}')" for p in scan.DENY_PATHS)
query("conversation_violations", f"SELECT conv_id, turn, CASE WHEN {_DENIED} THEN 'path_blocked' ELSE 'command_blocked' END AS violation, 'args' AS scope, 'bash' AS tool FROM conversations WHERE role = 'assistant' AND ({_DENIED} OR contains(regexp_replace(lower(text), '\\s+', ' ', 'g'), 'of the'))")(lambda s, d: payload.violations(bodies(s, d), commands=["OF  the"]).select("id.conv_id", "id.turn", "violation", "scope", "tool"))
_SIGHTINGS = "SELECT event_id AS id, ts, concat('s', CAST(user_id % 5 AS VARCHAR(20))) AS server, event_type AS tool, CASE WHEN event_id % 97 < 60 THEN 'aaaaaaaaaaaaaaaa' ELSE concat(CAST(event_id % 2 AS VARCHAR(20)), repeat('b', 63)) END AS fingerprint FROM events"
_SEEN = f"SELECT *, CASE WHEN was IS NULL THEN 'New' WHEN was = fingerprint OR (length(was) = 16 AND length(fingerprint) = 64) THEN 'Unchanged' ELSE 'Changed' END seen FROM (SELECT *, lag(fingerprint) OVER (PARTITION BY server, tool ORDER BY ts, id) was FROM ({_SIGHTINGS}))"
query("tool_fingerprints", f"SELECT id, server, tool, seen FROM ({_SEEN})")(lambda s, d: tools.observed(views.view(s, d, _SIGHTINGS), ["server", "tool"]).select("id", "server", "tool", "seen"))
query("tool_trust", f"WITH e AS (SELECT server, tool, ts, id, CASE WHEN id % 50 = 0 THEN 'approved' WHEN seen <> 'Unchanged' THEN 'pending' END state FROM ({_SEEN})) SELECT server, tool, arg_max(state, (ts, id)) AS state FROM e WHERE state IS NOT NULL GROUP BY 1, 2")(lambda s, d: tools.trust(tools.observed(views.view(s, d, _SIGHTINGS), ["server", "tool"]).withColumn("kind", F.when(F.col("id") % 50 == 0, "approve").otherwise(F.col("seen"))), ["server", "tool"]))
query("request_routes", "SELECT id, CASE WHEN p = '/click' OR starts_with(p, '/click/') THEN 'click' WHEN p = '/view' OR starts_with(p, '/view/') THEN 'view' ELSE 'default' END AS server, CASE WHEN starts_with(p, '/click/') THEN p[7:] WHEN starts_with(p, '/view/') THEN p[6:] WHEN p IN ('/click', '/view') THEN '/' ELSE p END AS forward FROM (SELECT event_id AS id, '/' || event_type || CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN '/a/b' ELSE 'x' END p FROM events)")(lambda s, d: views.view(s, d, "SELECT event_id AS id, concat('/', event_type, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN '/a/b' ELSE 'x' END) AS p FROM events").select("id", tools.route(F.col("p"), ["click", "view"]).alias("r")).select("id", "r.server", "r.forward"))
_OVERRIDES = [("gpt-5.5", 4.0, 0.0, 0.4, 20.0), ("own-model", 1.0, 1.25, 0.1, 5.0)]
query("effective_card", f"WITH {_CARD} SELECT key, 'override' AS source, 4.0::DOUBLE rate_in, 0.0::DOUBLE rate_cw, 0.4::DOUBLE rate_cr, 20.0::DOUBLE rate_out FROM (SELECT 'gpt-5.5' key) UNION ALL SELECT 'own-model', 'new', 1.0, 1.25, 0.1, 5.0 UNION ALL SELECT key, CASE WHEN key = 'gpt-5.5' THEN 'shadowed' ELSE 'built-in' END, ri, rw, rr, ro FROM card")(lambda s, d: card(s, _OVERRIDES).drop("ord"))
