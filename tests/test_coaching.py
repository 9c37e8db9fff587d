"""Coaching: tips against a plain version, stacked savings, price ratios and reminders."""

import datetime
import random
import re

from pyspark.sql import functions as F

from meterlake.operators import coaching
from meterlake.operators.coaching import Rules

RULES = Rules(long_chat_prompts=4, long_chat_min_dollars=3, older_min_dollars=1, big_context_tokens=900)
MODELS = ["a-1", "a-1-fast", "a-1-xhigh", "b-2-max", "b-2", "b-2-fast"]


def made():
    r, rows = random.Random(6), []
    for i in range(900):
        u = r.choice("uvwxyz")
        rows.append((i, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=r.randrange(30 * 1440)), u, r.choice(MODELS if u != "z" else MODELS[:1]), r.choice([f"{u}{r.randrange(9)}", None]), 0.0 if u == "y" else round(r.random() * 80, 2), r.choice([None, 5, 1000])))
    return rows


def plainly(rows, ratios, r):
    out = {}
    lo, hi = datetime.date(2024, 1, 5), datetime.date(2024, 1, 25)
    base = lambda m: re.sub("(-thinking)?(-(low|medium|high|xhigh|max))?(-thinking)?(-fast)?$", "", m)
    for u in "uvwxyz":
        own = sorted((x for x in rows if x[2] == u and lo <= x[1].date() < hi), key=lambda x: (x[1], x[0]))
        total = sum(x[5] for x in own)
        if total <= 0:
            continue
        tips, chats = [], {}
        for x in own:
            if x[4]:
                chats.setdefault(x[4], []).append(x[5])
        top = min(chats, key=lambda c: (-sum(chats[c]), c))
        cost, every = sum(chats[top]), [x[1] for x in rows if x[4] == top]
        if round(cost / 100, 2) >= r.long_chat_min_dollars and (round(cost / total, 4) >= r.long_chat_min_share or cost >= 2500) and (len(every) >= r.long_chat_prompts or round((max(every) - min(every)).total_seconds() / 86400, 1) >= 1):
            first = chats[top][: r.long_chat_prompts]
            saved = sum(max(0, c - sum(first) / len(first)) for c in chats[top][r.long_chat_prompts :]) * 0.5
            tips.append(("long_chat", round(cost / 100, 2), round(saved / 100, 2) if saved >= 100 else None))
        fast = sum(x[5] for x in own if "-fast" in x[3])
        if fast / total >= 0.3:
            tips.append(("fast", round(fast / 100, 2), round(fast * 0.45 / 100, 2)))
        mx = sum(x[5] for x in own if re.search(r"xhigh|-max\b|-max-", x[3]))
        if mx / total >= 0.3:
            tips.append(("max_effort", round(mx / 100, 2), None))
        old = [x for x in own if ratios.get(base(x[3]), 9) <= 0.9]
        if old and sum(x[5] for x in old) >= 100:
            tips.append(("legacy", round(sum(x[5] for x in old) / 100, 2), round(sum(x[5] * (1 - ratios[base(x[3])]) * (0.55 if "-fast" in x[3] else 1) for x in old) / 100, 2)))
        big = sum(x[5] for x in own if (x[6] or 0) > r.big_context_tokens)
        if big / total >= 0.3 and not any(t[0] == "long_chat" for t in tips):
            tips.append(("big_context", round(big / 100, 2), None))
        tips = sorted(tips, key=lambda t: -t[1])[:3]
        left = total / 100
        for s in sorted((t[2] for t in tips if t[2]), reverse=True):
            left -= s * left / (total / 100)
        out[u] = (tips, round(min(total / 100 - left, 0.6 * total / 100), 2))
    return out


def test_tips(spark):
    rows = made()
    events = spark.createDataFrame(rows, "id long, ts timestamp_ntz, user_email string, model string, conversation_id string, charged_cents double, cache_read_tokens long").withColumn("day", F.col("ts").cast("date")).repartition(5)
    lineup = spark.createDataFrame([("a-1", "a-2", 0.5), ("b-2", "b-3", 0.95), ("c", "d", None)], "family string, newest string, ratio double")
    every = coaching.every_tip(events, "2024-01-05", "2024-01-25", lineup, rules=RULES)
    shown = coaching.tips(every, RULES)
    got = {}
    for x in shown.orderBy("user_email", "rank").collect():
        got.setdefault(x["user_email"], []).append((x["id"], x["at_stake"], x["saving"]))
    want = plainly(rows, {"a-1": 0.5, "b-2": 0.95}, RULES)
    assert got == {u: t for u, (t, _) in want.items() if t} and len({t[0] for v in got.values() for t in v}) >= 4
    saved = {x["user_email"]: x["saving"] for x in coaching.stacked(shown, RULES).collect()}
    assert saved == {u: s for u, (t, s) in want.items() if t}
    what_if = spark.createDataFrame([("u", 7.25)], "user_email string, saving double")
    assert coaching.every_tip(events, "2024-01-05", "2024-01-25", lineup, what_if, RULES).filter("user_email = 'u' and id = 'fast'").first()["saving"] == 7.25


def test_savings_are_capped(spark):
    d = spark.createDataFrame([("a", 10.0, 5.0), ("a", 10.0, 5.0), ("b", 10.0, 9.0), ("c", 10.0, None)], "user_email string, total double, saving double")
    assert {r["user_email"]: r["saving"] for r in coaching.stacked(d).collect()} == {"a": 6.0, "b": 6.0, "c": 0.0}  # a would be 7.5


def test_price_ratios(spark):
    families = spark.createDataFrame([("old", [2.0, 10.0, 0.0, 1.0], [10, 1, 5, 100]), ("new", [1.0, 5.0, 9.0, 0.5], [1, 1, 1, 1]), ("none", None, [1, 1, 1, 1]), ("idle", [1.0] * 4, [0] * 4)], "family string, r array<double>, tokens array<long>")
    newer = spark.createDataFrame([("old", "new"), ("none", "new"), ("old", "none"), ("idle", "new"), ("gone", "new")], "family string, newest string")
    got = {(r["family"], r["newest"]): r["ratio"] for r in coaching.price_ratios(families, newer).collect()}
    assert got == {("old", "new"): (10 + 5 + 45 + 50) / (20 + 10 + 100), ("none", "new"): None, ("old", "none"): None, ("idle", "new"): None, ("gone", "new"): None}


def test_reminders(spark):
    rows = [(1.0, 0.0, 60_000, 0.1, 1, 0, last) for last in (None, "no_daily_budget", "low_cache_hit", "security_receipt", "other")] + [(1.0, 5.0, 60_000, 0.1, 0, 0, "low_cache_hit"), (0.0, 0.0, 10, 0.1, 0, 0, None), (1.0, 5.0, 60_000, 0.1, 0, 3, "no_daily_budget"), (1.0, 5.0, 60_000, 0.3, 0, 3, None)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, p long, h double, x long, y long, last string")
    got = [r[0] for r in d.orderBy("i").select(coaching.nudge(*(F.col(c) for c in ("a", "b", "p", "h", "x", "y", "last")))).collect()]
    assert got == ["no_daily_budget", "low_cache_hit", "security_receipt", "no_daily_budget", "no_daily_budget", "low_cache_hit", None, "low_cache_hit", "security_receipt"]
