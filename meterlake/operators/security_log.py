"""Security events as they are read: lists, counts by type in order of weight, what was stopped and what was only told,
and how a session pays.

Lists are ordered by time and id, so that equal times have one order.  Defined results: an unknown type counts as
enforcement; types of no fixed place follow by count, then name; a session without id has no flips.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Types in the order in which they are shown, types that only warn, and what stands for hidden details.
SEVERITY = [
    "canary_triggered", "destructive_blocked", "exfil_blocked", "secret_detected", "dlp_blocked", "obfuscation_blocked",
    "command_blocked", "path_blocked", "mount_blocked",
]
ADVISORY = ["slow_drip_alert", "billing_flip", "response_exfil_warning", "mcp_tool_poisoning", "mcp_tool_changed"]
REDACTED = "<redacted>"
#: How a plan's bearer of the first provider begins.
PLAN_BEARER = "sk-ant-oat"


def advisory(event_type: Column) -> Column:
    return F.coalesce(event_type.isin(ADVISORY), F.lit(False))


def newest(events: DataFrame, types: list[str] = (), provider: str | None = None, n: int | None = None) -> DataFrame:
    """Events from the newest, of some types, of a provider."""
    d = events.filter(F.col("event_type").isin(list(types))) if types else events
    d = d.filter(F.col("provider") == provider) if provider else d
    d = d.orderBy(F.desc("ts"), F.desc("id"))
    return d.limit(n) if n else d


def bundle(events: DataFrame, n: int = 50) -> DataFrame:
    """The oldest ``n`` events of a window, as diagnostic bundles take them, with details hidden."""
    return events.orderBy("ts", "id").limit(n).withColumn("details", F.when(F.col("details").isNotNull(), REDACTED))


def summary(events: DataFrame) -> DataFrame:
    """(rank, event_type, n, advisory): counts by type, those of fixed places first."""
    d = events.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("advisory", advisory(F.col("event_type")))
    place = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("event_type"))
    order = Window.orderBy(F.when(place > 0, place).otherwise(len(SEVERITY) + 1), F.when(place > 0, 0).otherwise(-F.col("n")), "event_type")  # a row for each type
    return d.select(F.row_number().over(order).alias("rank"), "event_type", "n", "advisory").orderBy("rank")


def daily_split(events: DataFrame) -> DataFrame:
    """(day, enforced, advised) of each day."""
    told = advisory(F.col("event_type"))
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(~told).alias("enforced"), F.count_if(told).alias("advised"))


def credential_kind(api_key: Column, authorization: Column, provider: Column) -> Column:
    """Metered, unless the first provider's bearer is known to be a plan's."""
    token = F.when(F.startswith(authorization, F.lit("Bearer ")) | F.startswith(authorization, F.lit("bearer ")), F.substring(authorization, F.lit(8), F.length(authorization)))
    plan = (F.length(F.coalesce(api_key, F.lit(""))) == 0) & (provider == "anthropic") & F.startswith(token, F.lit(PLAN_BEARER))
    return F.when(F.coalesce(plan, F.lit(False)), "subscription").otherwise("metered")


def billing_flips(calls: DataFrame) -> DataFrame:
    """(id, session_id): calls at which a session goes from its plan to metered billing; ``calls`` have id, ts, session_id, kind.
    Within a day from the call before, for a day's first call from the last one before that day."""
    from meterlake.operators.inspect_tools import previous

    d = previous(calls.filter("session_id is not null and session_id <> ''").select("id", "ts", "session_id", "kind"), ["session_id"], ["kind"])
    return d.filter("was_kind = 'subscription' and kind = 'metered'").select("id", "session_id")
