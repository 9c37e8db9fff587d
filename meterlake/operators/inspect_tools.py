"""Findings on advertised tools, in the order in which they are made, as security events.

Each sighting of a tool may have four findings: words of injection in its name or description; what the
scanners find in its whole definition; an input schema other than last time (which resets its approval); and, with the
schema as it was, another description.  A longer format of the same fingerprint is no change.

What a tool was like before is told by day: within a day from the row before, for a day's first row from the last row of
the day before it, of which there is one a tool.  So a tool that is seen all the time is no single task.

Defined results: null names are no tools; a null description is empty; sightings of one time are in order of id; the first
sight of a tool changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.operators import scan, tools

POISONED, CHANGED, REDACTED = "mcp_tool_poisoning", "mcp_tool_changed", "<redacted>"
#: The event of each kind of violation, and how it is said.
EVENTS = {
    "path_blocked": ("path_blocked", "attempted access to denied path: "),
    "command_blocked": ("command_blocked", "attempted denied command: "),
    "mount_blocked": ("mount_blocked", "attempted access to network mount: "),
    "secret": ("secret_detected", "payload contains a {} pattern"),
    "card_number": ("dlp_blocked", "payload contains possible data exfiltration: "),
    "ssn": ("dlp_blocked", "payload contains possible data exfiltration: "),
    "exfiltration": ("exfil_blocked", "tool call looks like data exfiltration: "),
    "destructive": ("destructive_blocked", "blocked a catastrophic command: "),
    "hidden_text": ("obfuscation_blocked", "invisible characters found hiding content: "),
    "canary": ("canary_triggered", "a planted canary credential attempted to leave the machine"),
}


def event_type(violation: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, (event, _) in EVENTS.items():
        out = F.when(violation == kind, event).otherwise(out)
    return out


def message(violation: Column, matched: Column) -> Column:
    """What happened, in a sentence."""
    out = F.lit(None).cast("string")
    for kind, (_, text) in EVENTS.items():
        before, hole, after = text.partition("{}")
        said = F.concat(F.lit(before), matched, F.lit(after)) if hole else F.concat(F.lit(text), matched) if text.endswith(": ") else F.lit(text)
        out = F.when(violation == kind, said).otherwise(out)
    return out


def previous(rows: DataFrame, key: list[str], of: list[str], order: tuple[str, str] = ("ts", "id")) -> DataFrame:
    """``rows`` with the ``of`` columns of the row before of the same key, as ``was_…``, and whether there was one (``seen``)."""
    d = rows.withColumn("_day", F.to_date(order[0]))
    own = F.struct(*(F.col(c).alias(c) for c in of))
    within = F.lag(own).over(Window.partitionBy(*key, "_day").orderBy(*order))
    last = d.groupBy(*key, "_day").agg(F.max_by(own, F.struct(*order)).alias("_last"))  # a row for each key and day
    last = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*key).orderBy("_day"))).drop("_last")
    d = d.withColumn("_own", within).join(last, [*key, "_day"])
    d = d.withColumn("_was", F.coalesce("_own", "_before"))
    return d.select(*rows.columns, *(F.col(f"_was.{c}").alias(f"was_{c}") for c in of), F.col("_was").isNotNull().alias("seen"))


def inspected(sightings: DataFrame, redact: bool = False, paths: list[str] = scan.DENY_PATHS, commands: list[str] = scan.DENY_COMMANDS) -> DataFrame:
    """(id, ts, ord, event_type, details, provider, model): events of sightings id, ts, server, name, description, schema_fingerprint, raw."""
    d = sightings.filter("name is not null").withColumn("description", F.coalesce("description", F.lit("")))
    d = previous(d, ["server", "name"], ["description", "schema_fingerprint"])
    longer = (F.length("was_schema_fingerprint") == 16) & (F.length("schema_fingerprint") == 64)
    schema = F.col("seen") & (F.col("was_schema_fingerprint") != F.col("schema_fingerprint")) & ~longer
    wording = F.col("seen") & ~schema & (F.col("was_description") != F.col("description"))
    d = d.withColumn("_marker", tools.marker(F.concat_ws(" ", "name", "description"))).withColumn("_found", scan.first_violation(F.col("raw"), paths, commands, exfil=False))
    one = lambda n, when, event, detail: F.when(when, F.struct(F.lit(n).alias("ord"), event.alias("event_type"), detail.alias("details")))
    found = F.array_compact(F.array(
        one(1, F.col("_marker").isNotNull(), F.lit(POISONED), F.col("_marker")), one(2, F.col("_found").isNotNull(), event_type(F.col("_found")), F.col("_found")),
        one(3, schema, F.lit(CHANGED), F.col("name")), one(4, wording, F.lit(CHANGED), F.col("name")),
    ))
    d = d.select("id", "ts", "name", F.inline(found))
    details = F.lit(REDACTED) if redact else F.col("details")
    return d.select("id", "ts", "ord", "event_type", details.alias("details"), F.lit("mcp").alias("provider"), F.col("name").alias("model"))
