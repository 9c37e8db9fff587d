"""Decisions on calls before they are forwarded: budgets, loops and spirals with feedback.

A refused call costs nothing and isn't counted, so each decision changes those after it: an owner's calls are folded
in order.  The order of checks: what the scanners found, the month's, day's and hour's budget, the session's, identical
calls, repeated actions, the cost of the last minutes.  Budgets hold for metered calls; those of a plan pass
unless the limits say otherwise.  Where a cheaper model stands in, a call beyond a month's, day's or hour's
budget goes on at that model's cost.

The same `Ledger` runs over a batch (owners side by side, each in order, in one pass that holds one owner's open
windows) and over a stream (`transformWithStateInPandas`: totals, windows and sessions as state, with a
lifetime).  Both can start from stored totals.  Money is whole billionths of a dollar.

Defined results: a call without owner belongs to the owner null and is decided like others (in a batch; a stream groups
it likewise); one without session has none; no, negative or null cost counts as nothing; a call that comes late is
decided as of the latest before it; calls of one time are in order of id.
"""

from __future__ import annotations

import datetime
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

NANO = 1_000_000_000
OUT = "owner string, id long, blocked boolean, reason string, fallback boolean, retry_after long, day_status string"
COLUMNS = ["owner", "id", "t", "session", "request", "action", "metered", "good", "nano", "fallback_nano", "violation"]


@dataclass(frozen=True)
class Limits:
    """Budgets in dollars, 0 for none; spans in seconds."""

    month: float = 0
    day: float = 0
    hour: float = 0
    session: float = 0
    warn_percent: float = 80
    enforce_on_plan: bool = False
    fallback: bool = False
    span: int = 300
    repeats: int = 5
    spiral: float = 0
    spiral_enforce: bool = False
    actions: int = 10
    actions_enforce: bool = False

    def reached(self, spent: int, name: str) -> bool:
        limit = round(getattr(self, name) * NANO)
        return limit > 0 and spent >= limit


def period(t: int) -> tuple[int, int]:
    """Day and month of microseconds since the epoch."""
    d = datetime.date(1970, 1, 1) + datetime.timedelta(days=t // 86_400_000_000)
    return d.toordinal(), d.year * 12 + d.month - 1


@dataclass
class Ledger:
    """What an owner has spent, and the calls of the last hour: (t, nano, request or None, action or None)."""

    last: int = -(1 << 62)
    day: int = 0
    month: int = 0
    day_spent: int = 0
    month_spent: int = 0
    sessions: dict = field(default_factory=dict)
    calls: deque = field(default_factory=deque)

    def roll(self, t: int) -> None:
        day, month = period(t)
        if day != self.day:
            self.day, self.day_spent = day, 0
        if month != self.month:
            self.month, self.month_spent = month, 0

    def day_status(self, limits: Limits) -> str:
        limit = round(limits.day * NANO)
        if limit <= 0:
            return "off"
        return "exceeded" if self.day_spent >= limit else "warn" if self.day_spent * 100 >= limit * limits.warn_percent else "ok"

    def decide(self, limits: Limits, t: int, session, request, action, metered: bool, good: bool, nano: int, fallback_nano: int, violation) -> tuple:
        """(blocked, reason, fallback, seconds to wait, state of the day's budget before the call)."""
        t = self.last = max(t, self.last)
        if violation is not None:
            self.roll(t)
            return True, violation, False, None, self.day_status(limits)
        self.roll(t)
        status, second = self.day_status(limits), 1_000_000
        widest = max(3600, limits.span) * second
        while self.calls and self.calls[0][0] < t - widest:
            self.calls.popleft()
        span = limits.span * second
        recent = [c for c in self.calls if c[0] >= t - span]
        hour = sum(c[1] for c in self.calls if c[0] >= t - 3600 * second)
        enforced, fallback = metered or limits.enforce_on_plan, False
        midnight = max(1, 86_400 - t // second % 86_400)
        for name, spent, reason, wait in (("month", self.month_spent, "monthly_budget_exceeded", midnight), ("day", self.day_spent, "budget_exceeded", midnight), ("hour", hour, "hourly_budget_exceeded", 3600)):
            if enforced and limits.reached(spent, name):
                if not limits.fallback:
                    return True, reason, False, wait, status
                fallback = True
                break
        if enforced and session is not None and limits.reached(self.sessions.get(session, 0), "session"):
            return True, "session_budget_exceeded", False, None, status
        if request is not None:
            same = [c[0] for c in recent if c[2] == request]
            if len(same) >= limits.repeats:
                return True, "loop_detected", False, max(1, limits.span - (t - same[0]) // second), status
            if action is not None and limits.actions:
                self.calls.append((t, 0, None, action))  # counted when seen
                again = 1 + sum(c[3] == action for c in recent)
                if again >= limits.actions and limits.actions_enforce:
                    return True, "action_loop_detected", False, limits.span, status
        if limits.spiral > 0 and limits.spiral_enforce and sum(c[1] for c in recent) > round(limits.spiral * NANO):
            return True, "cost_spiral", False, limits.span, status
        cost = max(0, fallback_nano if fallback else nano)
        self.day_spent += cost
        self.month_spent += cost
        if session is not None and cost and limits.session > 0:
            self.sessions[session] = self.sessions.get(session, 0) + cost
        if cost or (good and request is not None):
            self.calls.append((t, cost, request if good else None, None))
        return False, None, fallback, None, status


def arrivals(facts: DataFrame, owner: Column, request: Column, action: Column, metered: Column, fallback_nano: Column, violation: Column) -> DataFrame:
    """Priced facts as calls to decide on; ``request`` null for a call that can't loop (nothing asked in a body)."""
    good = (F.col("http_status") >= 200) & (F.col("http_status") < 300)
    return facts.select(
        owner.cast("string").alias("owner"), "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.nullif("session_id", F.lit("")).alias("session"),
        request.cast("string").alias("request"), action.cast("string").alias("action"), F.coalesce(metered, F.lit(True)).alias("metered"),
        F.coalesce(good, F.lit(False)).alias("good"), F.coalesce("nano", F.lit(0)).cast("long").alias("nano"),
        F.coalesce(fallback_nano, F.lit(0)).cast("long").alias("fallback_nano"), violation.cast("string").alias("violation"),
    )


def stored_totals(facts: DataFrame, owner: Column, as_of: str) -> DataFrame:
    """(owner, as_of, day_spent, month_spent) of priced facts of a day and its month up to it: what a ledger starts from."""
    day = F.lit(as_of).cast("date")
    own = facts.filter((F.col("day") <= day) & (F.col("day") >= F.trunc(day, "month"))).groupBy(owner.cast("string").alias("owner"))
    return own.agg(
        F.unix_micros(day.cast("timestamp")).alias("as_of"), F.coalesce(F.sum(F.when(F.col("day") == day, F.col("nano"))), F.lit(0)).alias("day_spent"), F.sum("nano").alias("month_spent")
    )


def opened(as_of, day_spent, month_spent) -> Ledger:
    out = Ledger()
    if not pd.isna(as_of):
        out.day, out.month = period(int(as_of))
        out.day_spent, out.month_spent = int(day_spent), int(month_spent)
    return out


def _rows(b: pd.DataFrame) -> Iterator[tuple]:
    none = lambda x: None if pd.isna(x) else x
    for r in b[COLUMNS].itertuples(index=False):
        yield none(r.owner), r.id, (int(r.t), none(r.session), none(r.request), none(r.action), bool(r.metered), bool(r.good), int(r.nano), int(r.fallback_nano), none(r.violation))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")])
    return out.astype({"retry_after": "Int64"})


def decide(calls: DataFrame, limits: Limits, stored: DataFrame | None = None) -> DataFrame:
    """(owner, id, blocked, reason, fallback, retry_after, day_status) of each call; ``stored`` from `stored_totals`."""
    if stored is None:
        none = F.lit(None).cast("long")
        calls = calls.select("*", none.alias("as_of"), none.alias("day_spent"), none.alias("month_spent"))
    else:
        given = stored.withColumnRenamed("owner", "_owner")
        calls = calls.join(given, F.col("owner").eqNullSafe(F.col("_owner")), "left").drop("_owner")
    ordered = calls.repartition("owner").sortWithinPartitions("owner", "t", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ledger, now, first = Ledger(), None, True
        for b in batches:
            out = []
            for (owner, ident, call), start in zip(_rows(b), b[["as_of", "day_spent", "month_spent"]].itertuples(index=False), strict=True):
                if first or owner != now:
                    ledger, now, first = opened(*start), owner, False
                out.append((owner, ident, *ledger.decide(limits, *call)))
            yield _frame(out)

    return ordered.mapInPandas(run, OUT)


class Decider(StatefulProcessor):
    """An owner's ledger as state: totals, calls of the open windows, and sessions, each with a lifetime."""

    def __init__(self, limits: Limits, lifetime_ms: int) -> None:
        self.limits, self.lifetime = limits, lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "last long, day long, month long, day_spent long, month_spent long", self.lifetime)
        self.calls = handle.getListState("calls", "t long, nano long, request string, action string", self.lifetime)
        self.sessions = handle.getMapState("sessions", "session string", "spent long", self.lifetime)

    def _put(self, ledger: Ledger, sessions: dict) -> None:
        self.totals.update((ledger.last, ledger.day, ledger.month, ledger.day_spent, ledger.month_spent))
        self.calls.put(list(ledger.calls)) if ledger.calls else self.calls.clear()
        for s, spent in sessions.items():
            self.sessions.updateValue((s,), (spent,))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        r = initialState.iloc[0]
        self._put(opened(r.as_of, r.day_spent, r.month_spent), {})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ledger = Ledger()
        if self.totals.exists():
            ledger.last, ledger.day, ledger.month, ledger.day_spent, ledger.month_spent = self.totals.get()
            ledger.calls = deque(tuple(c) for c in self.calls.get()) if self.calls.exists() else deque()
        given = pd.concat(list(rows)).sort_values(["t", "id"])  # one trigger's calls of one owner
        named = {s for s in given["session"] if not pd.isna(s)}
        ledger.sessions = {s: self.sessions.getValue((s,))[0] for s in named if self.sessions.containsKey((s,))}
        was = dict(ledger.sessions)
        out = [(owner, ident, *ledger.decide(self.limits, *call)) for owner, ident, call in _rows(given)]
        self._put(ledger, {s: v for s, v in ledger.sessions.items() if was.get(s) != v})
        yield _frame(out)

    def close(self) -> None:
        pass


def decision_stream(calls: DataFrame, limits: Limits, stored: DataFrame | None = None, lifetime_days: int = 62) -> DataFrame:
    """`decide` over a stream; calls of a trigger are in order, those of earlier triggers come first.  State of an owner
    or session that isn't touched for ``lifetime_days`` is dropped; more than a month by default.  A run that should end
    when all is read (`availableNow`) needs spark.sql.streaming.noDataMicroBatches.enabled off, as lifetimes go on."""
    start = None if stored is None else stored.groupBy("owner")
    return calls.groupBy("owner").transformWithStateInPandas(Decider(limits, lifetime_days * 86_400_000), OUT, "Append", "ProcessingTime", start)
