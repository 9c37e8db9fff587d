"""Which installed tools are seen through the proxy: a tool's providers stand for it, the freshest of them counts.

A tool is protected when a call to one of its providers is a day old at most, else it is installed and not seen.  The second
provider's tool with an account login goes to another place, whatever was seen.  Last calls are counted by owner and provider
before the join, so a busy owner is one row for each provider.

Defined results: a call after ``as_of`` has age 0; a tool without known providers is never seen; credentials that are no JSON,
or no object, have no mode; a tool installed twice by one owner has two rows; rows without owner are never seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Providers that a tool speaks to, the tool whose login bypasses, and seconds for which a call counts.
PROVIDERS = {"claude": ["anthropic"], "codex": ["openai"], "aider": ["anthropic", "openai"], "opencode": ["anthropic", "openai"]}
BYPASSING, RECENT = "codex", 24 * 3600
#: Fields of the credentials' file.
LOGIN_FIELD, KEY_FIELD = "tokens", "OPENAI_API_KEY"


def credential_mode(text: Column) -> Column:
    """login, api_key or null, by the shape of a credentials' file; no value of it is kept."""
    given = F.try_parse_json(text)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(given, f"$.{name}", "variant"))
    key = F.when(kind(KEY_FIELD) == "STRING", F.try_variant_get(given, f"$.{KEY_FIELD}", "string"))
    return F.when(F.startswith(kind(LOGIN_FIELD), F.lit("OBJECT")), "login").when(key != "", "api_key")


def providers_of(tool: Column) -> Column:
    out = F.array().cast("array<string>")
    for name, given in PROVIDERS.items():
        out = F.when(tool == name, F.array(*map(F.lit, given))).otherwise(out)
    return out


def tool_coverage(installed: DataFrame, calls: DataFrame, as_of: Column) -> DataFrame:
    """(owner, tool, mode, state, since_s) of installed owner, tool, credentials; ``calls`` have owner, provider, ts."""
    seen = calls.groupBy("owner", "provider").agg(F.max("ts").alias("ts"))
    tools = installed.select("owner", "tool", credential_mode(F.col("credentials")).alias("mode"))
    fresh = tools.select("owner", "tool").distinct().select("owner", "tool", F.explode(providers_of(F.col("tool"))).alias("provider")).join(seen, ["owner", "provider"]).groupBy("owner", "tool").agg(F.max("ts").alias("ts"))
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    d = tools.join(fresh, ["owner", "tool"], "left").withColumn("age", F.when(age < 0, 0).otherwise(age))
    bypass = (F.col("tool") == BYPASSING) & F.coalesce(F.col("mode") == "login", F.lit(False))
    state = F.when(bypass, "bypasses").when(F.col("age") <= RECENT, "protected").otherwise("installed_not_seen")
    return d.withColumn("state", state).select("owner", "tool", "mode", "state", F.when(F.col("state") == "protected", F.col("age")).alias("since_s"))
