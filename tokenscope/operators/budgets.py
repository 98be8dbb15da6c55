"""Alerts when use crosses shares of a budget, in batch and, row by row, on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budget_alerts(use: DataFrame, keys: Sequence[str], order: Sequence[str], limit: Column, thresholds: Sequence[int] = (80, 100)) -> DataFrame:
    """A row for each key and threshold (percent) whose use reached it: keys, order, usage with the row that did, limit, threshold, percentage.

    use has keys, tokens (not negative; null counts as none), ts and what else order names; order begins with ts and orders rows
    wholly. Use is summed by day first, and only rows of days in which a threshold is reached are put in order, so a key that
    holds most rows costs a sum, not a sort. A null or non-positive limit has no alert, as in ``BudgetAlerts``.
    """
    rows = use.select(*keys, *order, F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), limit.cast("long").alias("limit"), F.to_date(order[0]).alias("_day"))
    rows = rows.where("limit > 0")
    days = rows.groupBy(*keys, "_day").agg(F.sum("tokens").alias("_n"), F.max("limit").alias("_limit"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.withColumn("_before", before)
    reached = lambda prior, now, cap: F.filter(F.array(*map(F.lit, thresholds)), lambda t: (prior * 100 < t * cap) & (now * 100 >= t * cap))
    days = days.where(F.size(reached(F.col("_before"), F.col("_before") + F.col("_n"), F.col("_limit"))) > 0).drop("_n")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"d.{k}")) for k in (*keys, "_day")]
    some = rows.alias("r").join(days.alias("d"), same).select("r.*", "_before", "_limit")
    usage = F.col("_before") + F.sum("tokens").over(Window.partitionBy(*keys, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    some = some.withColumn("usage", usage)
    out = some.withColumn("threshold", F.explode(reached(F.col("usage") - F.col("tokens"), F.col("usage"), F.col("_limit"))))
    return out.select(*keys, *order, "usage", F.col("_limit").alias("limit"), "threshold", (F.col("usage") * 100.0 / F.col("_limit")).alias("percentage"))


class BudgetAlerts:
    """The same for one key on a stream (streaming.stateful.decide): the thresholds a row reached, with a comma between, else an empty text."""

    def __init__(self, limit: int, thresholds: Sequence[int] = (80, 100)) -> None:
        self.limit, self.thresholds, self.used = limit, tuple(thresholds), 0

    def step(self, tokens: int) -> str:
        prior, self.used = self.used, self.used + tokens
        return ",".join(str(t) for t in self.thresholds if 0 < self.limit and prior * 100 < t * self.limit <= self.used * 100)
