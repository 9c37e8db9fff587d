"""What a session's last turn has cost, from its running total as it was shown again and again.

While the total moves, a turn is under way and has cost what came since the turn before ended.  When the total is
shown unmoved, the turn is over: its cost stays, and the next one counts from here.  Both the base and the cost that
stays are the latest value of earlier rows, so the fold over turn borders is three windows by session.

Defined results: the first row of a session has no cost; a total that falls ends the turn, at its cost so far; rows without
session have none; rows of one time are in order of id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turn_costs(shown: DataFrame) -> DataFrame:
    """(id, session_id, total, moving, turn_cost) of rows id, ts, session_id, total (whole billionths)."""
    order = Window.partitionBy("session_id").orderBy("ts", "id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    d = shown.filter("session_id is not null").select("id", "ts", "session_id", "total", F.lag("total").over(order).alias("last"))
    d = d.withColumn("moving", F.col("total") > F.col("last"))
    d = d.withColumn("base", F.last(F.when(~F.coalesce("moving", F.lit(False)), F.col("total")), ignorenulls=True).over(before))
    own = F.when(F.col("moving") | (F.col("total") > F.col("base")), F.col("total") - F.col("base"))
    d = d.withColumn("own", own)
    kept = F.coalesce(F.last("own", ignorenulls=True).over(before), F.lit(0))
    cost = F.when(F.col("last").isNotNull(), F.coalesce("own", kept))
    return d.select("id", "session_id", "total", F.coalesce("moving", F.lit(False)).alias("moving"), cost.alias("turn_cost"))
