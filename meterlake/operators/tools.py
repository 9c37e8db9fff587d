"""Tools that servers advertise and that are called: parsing, markers, fingerprints, trust, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases of poisoned descriptions, and hidden characters in them.
MARKERS = [
    "ignore previous instruction", "ignore all previous", "disregard previous", "disregard all previous", "do not tell the user",
    "do not inform the user", "without informing the user", "without telling the user", "do not mention this", "<important>", "</important>", "system prompt",
]
HIDDEN = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]"


def reply(body: Column) -> Column:
    """A reply as a variant: JSON, or the last data line that is JSON."""
    bare = F.regexp_replace(body, r"^\x{FEFF}", "")
    data = F.filter(F.split(bare, r"\r?\n"), lambda x: F.startswith(x, F.lit("data:")))
    parsed = F.filter(F.transform(data, lambda x: F.try_parse_json(F.trim(F.substring(x, F.lit(6), F.length(x))))), lambda v: v.isNotNull())
    return F.coalesce(F.try_parse_json(bare), F.try_element_at(parsed, F.lit(-1)))


def advertised(replies: DataFrame, body: str = "body", *keep: str) -> DataFrame:
    """(name, description, schema, fingerprint, schema_fingerprint) of each tool of a reply that has a name."""
    tools = F.try_variant_get(reply(F.col(body)), "$.result.tools", "array<variant>")
    d = replies.select(*keep, F.explode(tools).alias("t"))
    name = F.when(F.schema_of_variant(F.variant_get("t", "$.name", "variant")) == "STRING", F.variant_get("t", "$.name", "string"))
    d = d.select(*keep, name.alias("name"), F.coalesce(F.try_variant_get("t", "$.description", "string"), F.lit("")).alias("description"), F.coalesce(F.to_json(F.variant_get("t", "$.inputSchema", "variant")), F.lit("null")).alias("schema"))
    joined = lambda *c: F.sha2(F.concat_ws("\0", *c), 256)
    return d.filter("name is not null").withColumn("fingerprint", joined("name", "description", "schema")).withColumn("schema_fingerprint", joined("name", "schema"))


def marker(text: Column) -> Column:
    """The first phrase of injection in a text, or that it hides characters."""
    low = F.lower(text)
    out = F.when(text.rlike(HIDDEN), "<hidden-unicode>")
    for m in reversed(MARKERS):
        out = F.when(F.contains(low, F.lit(m)), m).otherwise(out)
    return out


def observed(sightings: DataFrame, key: list[str], fingerprint: str = "fingerprint", order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """``sightings`` with what each tells (New, Unchanged, Changed).  A longer format of a fingerprint is no change."""
    was = F.lag(fingerprint).over(Window.partitionBy(*key).orderBy(*order))
    upgrade = (F.length(was) == 16) & (F.length(fingerprint) == 64)
    return sightings.withColumn("seen", F.when(was.isNull(), "New").when((was == F.col(fingerprint)) | upgrade, "Unchanged").otherwise("Changed"))


def trust(events: DataFrame, key: list[str], order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """(key, state): pending from the first sight and from each change on, until approved or revoked; ``kind`` is a
    sighting's New, Unchanged or Changed, or a command approve or revoke."""
    state = F.when(F.col("kind").isin("New", "Changed"), "pending").when(F.col("kind") == "approve", "approved").when(F.col("kind") == "revoke", "revoked")
    d = events.withColumn("state", state).filter("state is not null")
    return d.groupBy(*key).agg(F.max_by("state", F.struct(*order)).alias("state"))


def call(body: Column) -> Column:
    """(name, id) of a call of one tool, the id as text if it is a number or text; null for other messages."""
    v = F.try_parse_json(F.regexp_replace(body, r"^\x{FEFF}", ""))
    name, ident = F.variant_get(v, "$.params.name", "variant"), F.variant_get(v, "$.id", "variant")
    kind = F.schema_of_variant(ident)
    known = F.when((kind == "STRING") | kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.variant_get(ident, "$", "string"))
    return F.when((F.try_variant_get(v, "$.method", "string") == "tools/call") & (F.schema_of_variant(name) == "STRING"), F.struct(F.variant_get(name, "$", "string").alias("name"), known.alias("id")))


def route(path: Column, servers: list[str], default: bool = True) -> Column:
    """(server, forward): the first server whose name begins the path, else the default."""
    out = F.when(F.lit(default), F.struct(F.lit("default").alias("server"), path.alias("forward")))
    for s in reversed(servers):
        rest = F.substring(path, F.lit(len(s) + 2), F.length(path))
        out = F.when(path == f"/{s}", F.struct(F.lit(s).alias("server"), F.lit("/").alias("forward"))).when(F.startswith(path, F.lit(f"/{s}/")), F.struct(F.lit(s).alias("server"), rest.alias("forward"))).otherwise(out)
    return out


def matches(name: Column, glob: str) -> Column:
    """A pattern in which a star stands for any text."""
    return name.rlike("(?s)^" + ".*".join(r"\Q" + p + r"\E" if p else "" for p in glob.split("*")) + "$")


def decision(server: Column, tool: Column, violation: Column, state: Column, deny: list[str], servers: list[str], many: bool, enforce: bool) -> Column:
    """Why a call is blocked, null if it isn't: its contents, a denied name, a server not allowed, or no approval."""
    full = F.concat(server, F.lit("/"), tool)
    denied = F.lit(False)
    for g in deny:
        denied = denied | matches(full, g)
    beyond = F.lit(bool(servers) and many) & ~server.isin(servers or [""])
    return F.when(violation.isNotNull(), violation).when(denied, "denied").when(beyond, "server_not_allowed").when(F.lit(enforce) & (F.coalesce(state, F.lit("pending")) != "approved"), "not_approved")
