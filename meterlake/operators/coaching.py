"""Tips on how each person could spend less, what they would save together, and the one reminder to show.

Every rule is an aggregate over all users' events at once; a user's tips are then ranked by what is at stake.  Savings
don't add up: each works on what the ones before leave, largest first, and their sum is capped by a share of the spend.

Defined results: users without spend have no tips; chats without id count for no chat; ties of chats go to the smaller
id, ties of stakes to the earlier rule; a saving that is too small to quote is null and counts as none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.operators.team import between, family


@dataclass(frozen=True)
class Rules:
    """Thresholds of the tips."""

    max_tips: int = 3
    long_chat_prompts: int = 20
    long_chat_open_days: float = 1.0
    long_chat_min_dollars: float = 5.0
    long_chat_min_share: float = 0.15
    long_chat_big_dollars: float = 25.0
    long_chat_saving: float = 0.5
    min_saving_dollars: float = 1.0
    fast_min_share: float = 0.30
    fast_fallback_saving: float = 0.45
    max_effort_min_share: float = 0.30
    older_min_dollars: float = 20.0
    older_min_cheaper: float = 0.10
    big_context_tokens: int = 5_000_000
    big_context_min_share: float = 0.30
    max_saving_share: float = 0.6


ORDER = ["long_chat", "fast", "max_effort", "legacy", "big_context"]
MAX_EFFORT = r"xhigh|-max\b|-max-"


def _dollars(cents: Column) -> Column:
    return F.round(cents / 100, 2)


def _tip(d: DataFrame, kind: str, stake: Column, saving: Column) -> DataFrame:
    return d.select("user_email", F.lit(kind).alias("id"), stake.alias("at_stake"), saving.cast("double").alias("saving"))


def _long_chats(events: DataFrame, period: DataFrame, totals: DataFrame, r: Rules) -> DataFrame:
    own = period.filter("conversation_id is not null")
    spent = own.groupBy("user_email", "conversation_id").agg(F.sum("charged_cents").alias("c"))
    top = spent.groupBy("user_email").agg(F.min(F.struct((-F.col("c")).alias("c"), "conversation_id")).alias("t")).select("user_email", (-F.col("t.c")).alias("c"), "t.conversation_id")
    span = events.groupBy("conversation_id").agg(F.count("*").alias("n"), ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 86_400e6).alias("open"))
    order = Window.partitionBy("user_email", "conversation_id")
    nth = own.join(top.select("user_email", "conversation_id"), ["user_email", "conversation_id"]).withColumn("k", F.row_number().over(order.orderBy("ts", "id")))
    # a chat's first prompts are few; the rest is held against their mean in one pass
    first = nth.filter(F.col("k") <= r.long_chat_prompts).groupBy("user_email", "conversation_id").agg(F.avg("charged_cents").alias("base"))
    over = nth.filter(F.col("k") > r.long_chat_prompts).join(first, ["user_email", "conversation_id"])
    excess = over.groupBy("user_email").agg(F.sum(F.greatest(F.col("charged_cents") - F.col("base"), F.lit(0.0))).alias("excess"))
    d = top.join(span, "conversation_id").join(totals, "user_email").join(excess, "user_email", "left")
    share, saved = F.round(F.col("c") / F.col("total"), 4), F.coalesce("excess", F.lit(0.0)) * r.long_chat_saving
    d = d.filter(
        (_dollars(F.col("c")) >= r.long_chat_min_dollars) & ((share >= r.long_chat_min_share) | (_dollars(F.col("c")) >= r.long_chat_big_dollars))
        & ((F.col("n") >= r.long_chat_prompts) | (F.round("open", 1) >= r.long_chat_open_days))
    )
    return _tip(d, "long_chat", _dollars(F.col("c")), F.when(saved >= r.min_saving_dollars * 100, _dollars(saved)))


def every_tip(events: DataFrame, start: str, end: str, lineup: DataFrame, what_if: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """(user_email, id, at_stake, saving, total) of all tips, in dollars.  ``lineup``: family, newest, ratio (of `price_ratios`);
    ``what_if``: user_email, saving (of `team.fast_what_if`), else a share of fast spend is taken."""
    r, period = rules, between(events, start, end)
    fast = F.contains("model", F.lit("-fast"))
    part = lambda when: F.sum(F.when(when, F.col("charged_cents")).otherwise(0.0))
    older = lineup.filter(F.col("ratio") <= 1 - r.older_min_cheaper).select(F.col("family"), "ratio")
    p = period.withColumn("family", family(F.col("model"))).join(older, "family", "left")
    worth = F.col("charged_cents") * (1 - F.col("ratio")) * F.when(fast, 1 - r.fast_fallback_saving).otherwise(1.0)
    u = p.groupBy("user_email").agg(
        F.sum("charged_cents").alias("total"), part(fast).alias("fast"), part(F.col("model").rlike(MAX_EFFORT)).alias("max"), part(F.col("ratio").isNotNull()).alias("older"),
        F.coalesce(F.sum(worth), F.lit(0.0)).alias("worth"), part(F.coalesce("cache_read_tokens", F.lit(0)) > r.big_context_tokens).alias("big"),
    ).filter("total > 0")
    long = _long_chats(events, period, u.select("user_email", "total"), r)
    if what_if is None:
        u = u.withColumn("less", F.lit(None).cast("double"))
    else:
        u = u.join(what_if.select("user_email", F.col("saving").alias("less")), "user_email", "left")
    share = lambda c: F.col(c) / F.col("total")
    tips = [
        long, _tip(u.filter(share("fast") >= r.fast_min_share), "fast", _dollars(F.col("fast")), F.coalesce("less", _dollars(F.col("fast") * r.fast_fallback_saving))),
        _tip(u.filter(share("max") >= r.max_effort_min_share), "max_effort", _dollars(F.col("max")), F.lit(None)),
        _tip(u.filter((F.col("older") > 0) & (F.col("older") >= r.older_min_dollars * 100)), "legacy", _dollars(F.col("older")), _dollars(F.col("worth"))),
        _tip(u.filter(share("big") >= r.big_context_min_share).join(long.select("user_email"), "user_email", "left_anti"), "big_context", _dollars(F.col("big")), F.lit(None)),
    ]
    return reduce(DataFrame.unionByName, tips).join(u.select("user_email", (F.col("total") / 100).alias("total")), "user_email")


def tips(every: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(user_email, rank, id, at_stake, saving, total): the tips to show."""
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("id"))
    d = every.withColumn("rank", F.row_number().over(Window.partitionBy("user_email").orderBy(F.desc("at_stake"), place)))  # five a user at most
    return d.filter(F.col("rank") <= rules.max_tips).select("user_email", "rank", "id", "at_stake", "saving", "total")


def stacked(shown: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(user_email, saving) of the tips together."""
    d = shown.groupBy("user_email", "total").agg(F.sort_array(F.collect_list("saving"), asc=False).alias("s"))
    left = F.aggregate("s", F.col("total"), lambda a, s: a - s * a / F.col("total"))
    return d.select("user_email", F.round(F.least(F.col("total") - left, rules.max_saving_share * F.col("total")), 2).alias("saving"))


def price_ratios(families: DataFrame, newer: DataFrame) -> DataFrame:
    """(family, newest, ratio): what a family's usual tokens would cost on the newest one, as a share of what they cost now.
    ``families``: family, r (dollars a million by type of token), tokens (by type); ``newer``: family, newest."""
    cost = lambda r: F.aggregate(F.zip_with(r, F.col("tokens"), lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    now = families.filter("r is not null").select("family", "r", F.transform("tokens", lambda t: t.cast("double")).alias("tokens"))
    then = families.filter("r is not null").select(F.col("family").alias("newest"), F.col("r").alias("new_r"))
    d = newer.join(now, "family", "left").join(then, "newest", "left")
    before = cost(F.col("r"))
    return d.select("family", "newest", F.when(before > 0, cost(F.col("new_r")) / before).alias("ratio"))


#: Reminders in the order in which they take turns; a low hit rate, and prompt tokens that it must rest on.
ROTATION, LOW_HIT, TOKEN_FLOOR = ["no_daily_budget", "low_cache_hit", "security_receipt"], 0.20, 50_000


def nudge(spent: Column, budget: Column, prompt_tokens: Column, hit_rate: Column, blocked: Column, alerts: Column, last: Column) -> Column:
    """The reminder after the one shown last, of those that hold; null if none does."""
    holds = [(spent > 0) & (budget <= 0), (prompt_tokens >= TOKEN_FLOOR) & (hit_rate < LOW_HIT), (blocked > 0) | (alerts > 0)]
    able = F.array_compact(F.array(*(F.when(h, F.lit(k)) for k, h in zip(ROTATION, holds, strict=True))))
    at = F.coalesce(F.array_position(able, last), F.lit(0)).cast("int")  # from 1; 0: not among them
    return F.when(F.size(able) > 0, F.get(able, at % F.size(able)))
