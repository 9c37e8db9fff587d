"""A billing period as each member sees it: models with their shares, the dearest prompt, the day the limit was reached, notices.

All users at once.  Money is summed as whole millionths of a cent, so sums and ranks don't depend on the order of rows.  Events are
summed by user and model, or user and day, before anything looks at a user, so a user of very many events is a few rows by then.

Defined results: a charge of null is 0; a model of null or no name is "unknown"; of prompts of one charge the first one counts, then
the smaller id; a limit that is null or not positive is the default; events without user count nowhere; names are told in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.operators.team import between

DEFAULT_LIMIT, NOTICES, EVERYONE = 200.0, 5, "*"


def micro(cents: Column) -> Column:
    return F.round(F.coalesce(cents, F.lit(0.0)) * 1e6).cast("long")


def _of_period(events: DataFrame, start: str, end: str) -> DataFrame:
    d = between(events, start, end).filter("user_email is not null")
    return d.withColumns({"user_email": F.lower("user_email"), "micro": micro(F.col("charged_cents"))})


def model_shares(events: DataFrame, start: str, end: str) -> DataFrame:
    """(user_email, rank, model, cents, prompts, share): dearest first; shares of 0 where nothing was spent."""
    model = F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown"))
    by = _of_period(events, start, end).groupBy("user_email", model.alias("model")).agg(F.sum("micro").alias("c"), F.count("*").alias("prompts"))
    own = Window.partitionBy("user_email")  # a row for each model
    total = F.sum("c").over(own)
    rank = F.row_number().over(own.orderBy(F.desc("c"), "model"))
    return by.select("user_email", rank.alias("rank"), "model", (F.col("c") / 1e6).alias("cents"), "prompts", F.when(total != 0, F.round(F.col("c") / total, 4)).otherwise(0.0).alias("share"))


def top_prompts(events: DataFrame, start: str, end: str) -> DataFrame:
    """(user_email, id, ts, model, conversation_id, cents, cache_read_tokens): each user's dearest prompt."""
    first = F.struct("micro", -F.unix_micros(F.col("ts").cast("timestamp")), -F.col("id"))
    shown = F.struct("id", "ts", "model", "conversation_id", (F.col("micro") / 1e6).alias("cents"), "cache_read_tokens")
    return _of_period(events, start, end).groupBy("user_email").agg(F.max_by(shown, first).alias("p")).select("user_email", "p.*")


def limit_days(events: DataFrame, members: DataFrame, start: str, end: str, default: float = DEFAULT_LIMIT) -> DataFrame:
    """(user_email, cents, limit_dollars, reached_on): the first day whose running sum reaches the member's limit.
    Days without events change no sum, so only the others are summed up."""
    days = _of_period(events, start, end).groupBy("user_email", "day").agg(F.sum("micro").alias("c"))
    days = days.withColumn("running", F.sum("c").over(Window.partitionBy("user_email").orderBy("day")))  # a row for each day
    limits = members.filter("email is not null").groupBy(F.lower("email").alias("user_email")).agg(F.max(F.when(F.col("limit_dollars") > 0, F.col("limit_dollars"))).alias("own"))
    d = days.join(limits, "user_email", "left").withColumn("limit_dollars", F.coalesce("own", F.lit(default)))
    hit = F.col("running") / 1e8 >= F.col("limit_dollars")
    return d.groupBy("user_email").agg((F.sum("c") / 1e6).alias("cents"), F.first("limit_dollars").alias("limit_dollars"), F.min(F.when(hit, F.col("day"))).alias("reached_on"))


def notices_for(users: DataFrame, notices: DataFrame, k: int = NOTICES) -> DataFrame:
    """(user_email, rank, id): each user's ``k`` newest notices, to them or to everyone; ``users`` have user_email, ``notices`` id,
    created_at and target.  A target's ``k`` newest are taken first, which Spark does before it moves them, so those to
    everyone are at most ``k`` rows beside each user and no target is large."""
    newest = [F.desc("created_at"), F.desc("id")]
    n = notices.filter("target is not null").select("id", "created_at", F.lower("target").alias("target"))
    n = n.withColumn("of_target", F.row_number().over(Window.partitionBy("target").orderBy(*newest))).filter(F.col("of_target") <= k)
    u = users.filter("user_email is not null").select(F.lower("user_email").alias("user_email")).distinct()
    own = u.join(n.filter(F.col("target") != EVERYONE), F.col("user_email") == F.col("target"))
    shared = u.withColumn("to", F.lit(EVERYONE)).join(F.broadcast(n.filter(F.col("target") == EVERYONE)), F.col("to") == F.col("target"))  # k rows
    both = own.select("user_email", "id", "created_at").unionByName(shared.select("user_email", "id", "created_at"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("user_email").orderBy(*newest))).filter(F.col("rank") <= k).select("user_email", "rank", "id")
