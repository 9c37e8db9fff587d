"""Rule packs, findings on advertised tools and costs of turns, against plain versions."""

import datetime
import random

from pyspark.sql import functions as F

from meterlake.operators import inspect_tools, packs, turns

GOOD = """id = "mine"
name = "Mine"
version = "1.2.3"
deny_paths = ["~/.vault", 'C:\\Secrets']
deny_commands = ["Drop  It", "drop it"]
[[secret_patterns]]
name = "token"
regex = 'tok_[0-9]{4}'
[[secret_patterns]]
name = "bad"
regex = '(['
"""
FILES = {
    "good": GOOD, "toml": "id = ", "types": 'id = "x"\ndeny_paths = "~/.a"', "noid": 'name = "n"\nversion = "1"\ndeny_paths = ["/x/y"]', "empty": 'id = "e"\nname = "e"\nversion = "1.0.0"',
    "loose": 'id = "l"\nname = "l"\nversion = "1.0.0"\nallow_paths = ["/"]\nextra = 1\ndeny_paths = ["/", "/ok/here"]\ndeny_commands = ["git", "git push --force"]\n[[secret_patterns]]\nname = " "\nregex = ".*"',
    "many": 'id = "m"\nname = "m"\nversion = "1.0.0"\ndeny_paths = [' + ",".join(f'"/p{i}"' for i in range(2001)) + "]", "large": "# " + "x" * packs.MAX_BYTES, "null": None,
}


def files(spark, given=FILES):
    return spark.createDataFrame(list(given.items()), "path string, text string")


def test_lint_and_acceptance(spark):
    p = packs.parsed(files(spark))
    got = {}
    for r in packs.lint(p).collect():
        got.setdefault(r["path"], set()).add((r["severity"], r["code"]))
    e, w = "error", "warning"
    assert got == {
        "good": {(e, "bad-regex")}, "toml": {(e, "malformed-toml")}, "types": {(e, "malformed-toml")}, "noid": {(e, "missing-id"), (w, "version-format")}, "empty": {(e, "empty-pack")},
        "loose": {(e, "forbidden-key"), (e, "unknown-key"), (e, "overbroad-path"), (e, "overbroad-command"), (e, "unnamed-pattern"), (e, "overbroad-regex")},
        "many": {(e, "too-many-rules")}, "large": {(e, "too-large")}, "null": {(e, "missing-id"), (w, "missing-name"), (w, "missing-version"), (e, "empty-pack")},
    }
    assert {r["path"] for r in p.filter("accepted").collect()} == {"good", "empty", "loose"}
    assert {tuple(x) for x in p.filter("path = 'good'").first()["rules"]} == {("path", "~/.vault", "~/.vault"), ("path", "C:\\Secrets", "C:\\Secrets"), ("command", "Drop  It", "Drop  It"), ("command", "drop it", "drop it"), ("pattern", "token", "tok_[0-9]{4}")}


def test_pins(spark):
    p = packs.parsed(files(spark, {"a": GOOD, "b": GOOD.replace('"mine"', '"other"'), "c": GOOD.replace('"mine"', '"third"'), "d": GOOD.replace('"mine"', '"django"'), "z": GOOD + "# twice"}))
    pins = p.filter("path in ('a', 'b')").select("id", F.when(F.col("path") == "b", "0").otherwise(F.col("content_hash")).alias("content_hash"))
    t = packs.trust(p, pins)
    assert {(r["path"], r["state"]) for r in t.collect()} == {("a", "pinned"), ("b", "changed"), ("c", "new"), ("d", "taken")}
    assert {r["pack"] for r in packs.rules_of(t).collect()} == {"mine"}


def test_matches(spark):
    p = packs.parsed(files(spark, {"a": GOOD}))
    rules = packs.rules_of(packs.trust(p, p.select("id", "content_hash")))
    texts = ["cat /home/me/.VAULT/x", "~/.vault", "c:/secrets/y", "now DROP\n\tit.", "tok_1234 tok_99", "clean .vault", None, "", "C:\\SECRETS and drop it tok_0000" * 3]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("pack", F.lit("clash"))
    got = {}
    for r in packs.matches(d, rules, "doc_id").collect():
        got.setdefault(r["doc_id"], []).append((r["kind"], r["name"]))
    path, command = ("path", "~/.vault"), [("command", "Drop  It"), ("command", "drop it")]
    assert {k: sorted(v) for k, v in got.items()} == {0: [path], 1: [path], 2: [("path", "C:\\Secrets")], 3: command, 4: [("pattern", "token")], 8: [*command, ("path", "C:\\Secrets"), ("pattern", "token")]}
    assert packs.matches(d, rules.filter("false"), "doc_id").collect() == [] and packs.matches(d.filter("false"), rules, "doc_id").collect() == []
    assert packs.bundled(spark).select("pack").distinct().count() == 8


def test_inspections(spark):
    """Findings of sightings over several days against a walk."""
    r, rows, start = random.Random(5), [], datetime.datetime(2024, 1, 1)
    for i in range(300):
        text = r.choice(["does a", "does b", None, "do not tell the user"])
        raw = r.choice(["x", "x", "cat ~/.ssh/id", "AKIA" + "A" * 16])
        rows.append((i, start + datetime.timedelta(hours=r.randrange(90)), r.choice("st"), r.choice(["n", "m", None]), text, r.choice(["a" * 16, "b" * 64, "c" * 64]), raw))
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, server string, name string, description string, schema_fingerprint string, raw string")
    got = sorted((x["id"], x["ord"], x["event_type"], x["details"], x["model"]) for x in inspect_tools.inspected(df).collect())
    want, last = [], {}
    for i, _, server, name, text, fp, raw in sorted(rows, key=lambda x: (x[1], x[0])):
        if name is None:
            continue
        text = text or ""
        if "do not tell" in text:
            want.append((i, 1, "mcp_tool_poisoning", "do not tell the user", name))
        if raw != "x":
            want.append((i, 2, *(("path_blocked", "path_blocked") if ".ssh" in raw else ("secret_detected", "secret")), name))
        if (server, name) in last:
            was, then = last[server, name]
            changed = then != fp and not (len(then) == 16 and len(fp) == 64)
            if changed or was != text:
                want.append((i, 3 if changed else 4, "mcp_tool_changed", name, name))
        last[server, name] = (text, fp)
    assert got == sorted(want)
    assert {x["details"] for x in inspect_tools.inspected(df, redact=True).collect()} == {"<redacted>"}
    one = spark.createDataFrame([("secret", "github"), ("canary", "x"), ("path_blocked", "~/.ssh"), ("other", "x")], "v string, m string")
    assert [x[0] for x in one.select(inspect_tools.message(F.col("v"), F.col("m"))).collect()] == ["payload contains a github pattern", "a planted canary credential attempted to leave the machine", "attempted access to denied path: ~/.ssh", None]


def test_turn_costs(spark):
    """The same as a walk that keeps base, last total and last cost."""
    r, rows = random.Random(9), []
    for s in ("a", "b", None):
        total = 0
        for i in range(80):
            total = max(0, total + r.choice([0, 0, 5, 7, -20]))
            rows.append((len(rows), datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i // 2), s, total))
    got = {x["id"]: x["turn_cost"] for x in turns.turn_costs(spark.createDataFrame(rows, "id long, ts timestamp_ntz, session_id string, total long").repartition(4)).collect()}
    want = {}
    for s in ("a", "b"):
        state = None
        for i, _, _, total in (x for x in rows if x[2] == s):
            if state is None:
                want[i], state = None, (total, total, 0)
                continue
            base, seen, cost = state
            if total > seen:
                want[i] = max(total - base, 0)
                state = (base, total, want[i])
            else:
                want[i] = total - base if total > base else cost
                state = (total, total, want[i])
    assert got == want
