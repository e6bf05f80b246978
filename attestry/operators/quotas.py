"""Quota levels of counted actions, and what each priority may still do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators.rules import quota_level

#: What is deferred or suppressed at a level; all else is sent.
DEFERRED = {"restrict": ("P3",), "emergency": ("P2", "P3", "P4"), "exhausted": ("P1", "P2", "P3", "P4")}
SUPPRESSED = {"restrict": ("P4",)}


def usage(actions: DataFrame, limit: int, ts: str = "ts", order: str = "event_id", period: str = "day", *by: str) -> DataFrame:
    """Each action with its number within its period, percent used and level.

    Counts start anew each period and key, so they run in parallel by both.
    """
    span = F.date_trunc(period, F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*by, span).orderBy(ts, order)
    used = actions.withColumn("used", F.row_number().over(w).cast("long")).withColumn("percent", 100.0 * F.col("used") / limit)
    return used.withColumn("level", quota_level(F.col("percent")))


def verdict(priority: Column, level: Column) -> Column:
    """send, defer or suppress."""

    def listed(table: dict[str, tuple[str, ...]]) -> Column:
        return reduce(lambda a, b: a | b, [(level == k) & priority.isin(*ps) for k, ps in table.items()])

    return F.when(listed(SUPPRESSED), "suppress").when(listed(DEFERRED), "defer").otherwise("send")
