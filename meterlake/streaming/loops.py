"""Exact loop detection: refused calls don't enter the window, so each key is folded in order.

The same fold runs over a batch (`applyInPandas`, parts in order) and over a stream
(`applyInPandasWithState`); state is one list of at most `threshold` times a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, id long, blocked boolean, retry_after long"


def fold(times: list[int], now: int, good: bool, span: int, threshold: int) -> tuple[list[int], bool, int]:
    """Window after one arrival, whether it is refused, and seconds until it would not be."""
    times = [t for t in times if now - t <= span]
    if len(times) >= threshold:
        return times, True, span - (now - times[0])
    return ([*times, now] if good else times), False, 0


def _run(rows: pd.DataFrame, times: list[int], span: int, threshold: int) -> tuple[pd.DataFrame, list[int]]:
    out = []
    for r in rows.itertuples():
        times, blocked, wait = fold(times, r.t, r.good, span, threshold)
        out.append((r.key, r.id, blocked, wait))
    return pd.DataFrame(out, columns=["key", "id", "blocked", "retry_after"]), times


def arrivals(facts: DataFrame, key: str) -> DataFrame:
    """(key, id, t, good): seconds, and whether the call succeeded."""
    good = (F.col("http_status") >= 200) & (F.col("http_status") < 300)
    return facts.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), "id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), good.alias("good"))


def loops(facts: DataFrame, key: str, span: int = 300, threshold: int = 5) -> DataFrame:
    """A key's rows come sorted and in batches; only the window is held between them."""
    ordered = arrivals(facts, key).repartition("key").sortWithinPartitions("key", "t", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, times = None, []
        for b in batches:
            for k, g in b.groupby("key", sort=False):
                out, times = _run(g, times if k == last else [], span, threshold)
                last = k
                yield out

    return ordered.mapInPandas(run, OUT)


def loop_stream(facts: DataFrame, key: str, span: int = 300, threshold: int = 5) -> DataFrame:
    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["t", "id"])  # one trigger's rows of one key
        out, times = _run(rows, times, span, threshold)
        state.update((times,))
        yield out

    return arrivals(facts, key).groupBy("key").applyInPandasWithState(run, OUT, "times array<long>", "append", GroupStateTimeout.NoTimeout)
