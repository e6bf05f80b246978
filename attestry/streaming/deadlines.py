"""Keys that end at a fixed time after they were opened, by silence alone.

Sessions of 30 minutes from their creation, whatever happens in between, and
requests that fall due after 30 days have the same shape: an ``open`` event starts
the clock of its key once, a ``close`` event before the deadline stops it, and when
the deadline has passed without one, that is an event of its own.  In a stream an
event-time timer makes it; no further row of the key is needed.

Answers to events, in order of time and ``event_id``: ``opened``, ``active`` (an event
before or at the deadline), ``closed``, ``ended`` (after it was closed), ``expired``
(after the deadline), ``unknown`` (no open event so far, or over ``keep`` after the
deadline, when the key has been forgotten; keys are not used again).  The row of the deadline itself is
``deadline``, without an ``event_id``.  Rows without a key or a time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

NAMES = ("event_id", "at_us", "answer")
ROW = "event_id long, at_us long, answer string"


def _flat(events: DataFrame, key: str, ts: str) -> DataFrame:
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()) if not events.isStreaming else events.where(F.col(key).isNotNull())
    return rows.select(F.col(key), F.col("event_id").cast("long"), F.col(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"), F.col("kind").cast("string"))


def batch(events: DataFrame, as_of_us: int, ttl_s: float, keep_s: float = 0.0, key: str = "session_id", ts: str = "ts") -> DataFrame:
    """All answers, and deadlines before ``as_of_us``.

    Windows over one sort of each key; nothing else is shuffled.
    """
    ttl, keep = round(ttl_s * 1e6), round(keep_s * 1e6)
    order = Window.partitionBy(key).orderBy("at_us", "event_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = _flat(events, key, ts)
    rows = rows.withColumn("opened", F.min(F.when(F.col("kind") == "open", F.col("at_us"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("was_open", F.coalesce(F.max(F.col("opened").isNotNull()).over(before), F.lit(False)))
    in_time = (F.col("at_us") <= F.col("opened") + ttl) & F.col("opened").isNotNull()
    rows = rows.withColumn("stops", in_time & F.col("was_open") & (F.col("kind") == "close"))
    rows = rows.withColumn("stopped", F.coalesce(F.max("stops").over(before), F.lit(False)))
    answer = (
        F.when(F.col("opened").isNull(), "unknown")
        .when(~F.col("was_open"), "opened")
        .when(F.col("at_us") > F.col("opened") + ttl + keep, "unknown")
        .when(F.col("stopped"), "ended")
        .when(~in_time, "expired")
        .when(F.col("kind") == "close", "closed")
        .otherwise("active")
    )
    rows = rows.withColumn("answer", answer)
    ever = F.coalesce(F.max("stops").over(Window.partitionBy(key)), F.lit(False))
    ends = F.struct(F.lit(None).cast("long").alias("event_id"), (F.col("at_us") + ttl).alias("at_us"), F.lit("deadline").alias("answer"))
    own = F.struct("event_id", "at_us", "answer")
    due = (F.col("answer") == "opened") & ~F.col("ever") & (F.col("at_us") + ttl < as_of_us)
    rows = rows.withColumn("ever", ever)
    return rows.select(key, F.inline(F.when(due, F.array(own, ends)).otherwise(F.array(own))))


class _Clock(StatefulProcessor):
    def __init__(self, key: str, ttl_us: int, keep_us: int):
        self.key, self.ttl, self.keep = key, ttl_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("clock", "opened long, stopped boolean, told boolean")

    def _timer(self, at_us: int) -> None:
        self.handle.registerTimer(at_us // 1000 + 1)  # once the deadline has passed

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        opened, stopped, told = self.state.get() if self.state.exists() else (None, False, False)
        out = []
        for event_id, at, kind in pd.concat(list(rows)).sort_values(["at_us", "event_id"])[["event_id", "at_us", "kind"]].itertuples(index=False):
            if opened is None:
                if kind != "open":
                    out.append((event_id, at, "unknown"))
                    continue
                opened = int(at)
                self._timer(opened + self.ttl)
                out.append((event_id, at, "opened"))
            elif at > opened + self.ttl + self.keep:
                out.append((event_id, at, "unknown"))
            elif stopped:
                out.append((event_id, at, "ended"))
            elif at > opened + self.ttl:
                out.append((event_id, at, "expired"))
            elif kind == "close":
                stopped = True
                out.append((event_id, at, "closed"))
            else:
                out.append((event_id, at, "active"))
        if opened is not None:
            self.state.update((opened, stopped, told))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        opened, stopped, told = self.state.get()
        if told:
            self.state.clear()  # forgotten
            return
        self.state.update((opened, stopped, True))
        self._timer(opened + self.ttl + self.keep + 1000)
        if not stopped:
            yield self._frame(key, [(None, opened + self.ttl, "deadline")])

    def _frame(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=[self.key, *NAMES]).astype({"event_id": "Int64", "at_us": "int64"})

    def close(self) -> None:
        pass


def stream(events: DataFrame, ttl_s: float, keep_s: float = 0.0, key: str = "session_id", ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """The same rows from a stream, which needs the RocksDB state store."""
    flat = _flat(events.withWatermark(ts, late), key, ts)
    kind = events.schema[key].dataType.simpleString()
    return flat.groupBy(key).transformWithStateInPandas(statefulProcessor=_Clock(key, round(ttl_s * 1e6), round(keep_s * 1e6)), outputStructType=f"{key} {kind}, {ROW}", outputMode="Append", timeMode="EventTime")
