"""Continuous authentication of sessions, for batch and stream alike.

Signals (``type``, ``value``, ``drift``) of a session move one machine: trust rises
to the baseline, drift is a moving average of the last ``most`` signals, begun anew
with the oldest of them.  At ``revoke`` the session ends for good; from
``reverify`` on it is to be verified again, and below that it is active once more.
A session that has been silent for ``interval_s`` is due: that is a row of its own,
at the time it fell due, from an event-time timer in a stream.

Both forms feed the same ``Session``: a batch reads partitions sorted by session and
time, so no session is held as a whole; a stream keeps a typed value and a list of
signals.  A stream that gets the signals of a session in order gives the rows of
the batch, for every time up to its watermark.  A signal older than one of its
session that has been answered is ``late`` and changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from decimal import ROUND_HALF_UP, Decimal
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Rules(NamedTuple):
    alpha: float = 0.3
    revoke: float = 0.40
    reverify: float = 0.15
    most: int = 100
    interval_s: float = 300.0
    baseline: float = 1.0


#: The modality that repairs a kind of signal; its order is that of ties.
MODALITY = {"face": "face", "voice": "voice", "behavioral": "behavioral", "device": "device", "location": "device"}

ROW = "event_id long, at_us long, action string, status string, n long, trust double, drift double, trend string, confidence double, should boolean, reason string, modality string"
NAMES = tuple(column.split()[0] for column in ROW.split(", "))
TRAIL = "seq long, at_us long, action string, details string, hash string"


def unit(x: float | None) -> float:
    """Within 0 to 1; no number counts as 0."""
    return 0.0 if x is None or x != x else min(1.0, max(0.0, float(x)))


def fixed(x: float) -> str:
    """Three decimals, half up."""
    return str(Decimal(x).quantize(Decimal("0.001"), ROUND_HALF_UP))


@dataclass
class Session:
    """One session's state; ``signal`` and ``silence`` return what happened."""

    rules: Rules
    status: str = "active"
    n: int = 0
    trust: float = 1.0
    last_us: int | None = None
    due_us: int | None = None
    signals: list[tuple[str | None, float, float]] = field(default_factory=list)
    seq: int = 0
    hash: str = "genesis"
    trail: list[tuple] = field(default_factory=list)

    def note(self, at_us: int, action: str, details: str) -> None:
        """An entry of the audit trail; each hash covers the one before it."""
        at = datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=at_us)
        stamp = f"{at:%Y-%m-%dT%H:%M:%S}.{at.microsecond // 1000:03d}Z"
        self.hash = hashlib.sha256(f"{self.hash}|{stamp}|{action}|{details}".encode()).hexdigest()
        self.seq += 1
        self.trail.append((self.seq, at_us, action, details, self.hash))

    def drift(self) -> float:
        ema = self.signals[0][2] if self.signals else 0.0
        for _, _, d in self.signals[1:]:
            ema = self.rules.alpha * d + (1 - self.rules.alpha) * ema
        return ema

    def trend(self) -> str:
        half = max(1, len(self.signals) // 2)
        mean = lambda part: sum(d for _, _, d in part) / len(part) if part else 0.0
        change = mean(self.signals[half:]) - mean(self.signals[:half])
        return "increasing" if change > 0.02 else "decreasing" if change < -0.02 else "stable"

    def worst(self) -> str:
        """Modality of the largest sum of drifts among the last five signals; the first of equals."""
        sums: dict[str | None, float] = {}
        for kind, _, d in self.signals[-5:]:
            sums[kind] = sums.get(kind, 0.0) + d
        return MODALITY.get(max(sums, key=sums.get) or "", "face") if sums else "face"

    def row(self, event_id: int | None, at_us: int, action: str, drift: float, due: bool = False) -> tuple:
        if self.status == "revoked":
            why, modality = "revoked", "face"
        elif drift >= self.rules.reverify:
            why, modality = "drift", self.worst()
        elif due:
            why, modality = "interval", self.worst()
        elif self.n < 3:
            why, modality = "few_signals", "behavioral"
        else:
            why, modality = None, "face"
        return (event_id, at_us, action, self.status, self.n, self.trust, drift, self.trend(), min(1.0, len(self.signals) / 10), why is not None, why, modality)

    def silence(self, until_us: int) -> list[tuple]:
        """The row of a due time that is not after ``until_us``."""
        if self.due_us is None or self.due_us > until_us:
            return []
        at, self.due_us = self.due_us, None
        return [self.row(None, at, "reverify_due", self.drift(), due=True)]

    def signal(self, event_id: int, at_us: int, kind: str | None, value: float | None, drift: float | None) -> list[tuple]:
        rules = self.rules
        if self.last_us is None:
            self.trust = unit(rules.baseline)
            self.note(at_us, "session_start", f"baseline={fixed(self.trust)}")
        elif at_us < self.last_us:
            return [self.row(event_id, at_us, "late", self.drift())]
        if self.status == "revoked":
            return [self.row(event_id, at_us, "error", self.drift())]
        out = self.silence(at_us)
        self.signals = [*self.signals, (kind, unit(value), unit(drift))][-rules.most :]
        self.n, self.last_us, self.due_us = self.n + 1, at_us, at_us + round(rules.interval_s * 1e6)
        self.trust = unit(self.trust + (unit(rules.baseline) - self.trust) * 0.5 * unit(value))
        now, action = self.drift(), "signal_recorded"
        if now >= rules.revoke:
            self.status, self.trust, self.due_us, action = "revoked", 0.0, None, "session_revoked"
            self.note(at_us, action, f"drift {fixed(now)} ≥ revocation threshold {rules.revoke:g}")
            return [*out, self.row(event_id, at_us, action, now)]
        if now >= rules.reverify and self.status == "active":
            self.status, action = "reverify", "reverify_flagged"
            self.note(at_us, action, f"drift {fixed(now)}")
        elif now < rules.reverify and self.status == "reverify":
            self.status, action = "active", "reverify_cleared"
            self.note(at_us, action, f"drift dropped to {fixed(now)}")
        self.note(at_us, "signal_recorded", f"type={kind} value={fixed(unit(value))} drift={fixed(unit(drift))}")
        return [*out, self.row(event_id, at_us, action, now)]


def _signals(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Signals without a session or a time can't be placed and are left out."""
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    return rows.select(F.col(key), F.col("event_id").cast("long"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"), F.col("type").cast("string"), F.col("value").cast("double"), F.col("drift").cast("double"))


def _replayed(events: DataFrame, key: str, ts: str, rules: Rules, as_of_us: int, trail: bool) -> DataFrame:
    kind = events.schema[key].dataType.simpleString()
    schema = T.StructType.fromDDL(f"{key} {kind}, {TRAIL if trail else ROW}")
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, session = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if session is None or row[key] != name:
                    if session is not None and not trail:
                        out += [(name, *r) for r in session.silence(as_of_us)]
                    name, session = row[key], Session(rules)
                rows = session.signal(row["event_id"], row["at_us"], row["type"], row["value"], row["drift"])
                out += [(name, *r) for r in (session.trail if trail else rows)]
                session.trail = []
            yield table(out)
        if session is not None and not trail:
            yield table([(name, *r) for r in session.silence(as_of_us)])

    return _signals(events, key, ts).repartition(key).sortWithinPartitions(key, "at_us", "event_id").mapInArrow(run, schema)


def batch(events: DataFrame, as_of_us: int, key: str = "session_id", ts: str = "ts", rules: Rules = Rules()) -> DataFrame:
    """A row for each signal and each due time until ``as_of_us``, signals of one time by ``event_id``."""
    return _replayed(events, key, ts, rules, as_of_us, trail=False)


def audit(events: DataFrame, key: str = "session_id", ts: str = "ts", rules: Rules = Rules()) -> DataFrame:
    """The audit trail of each session: entries whose hashes are chained from "genesis"."""
    return _replayed(events, key, ts, rules, 0, trail=True)


class _Machine(StatefulProcessor):
    def __init__(self, key: str, rules: Rules):
        self.key, self.rules = key, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("session", "status string, n long, trust double, last_us long, due_us long")
        self.last = handle.getListState("signals", "type string, value double, drift double")

    def _load(self) -> Session:
        if not self.now.exists():
            return Session(self.rules)
        status, n, trust, last_us, due_us = self.now.get()
        whole = lambda x: None if x is None or x != x else int(x)
        return Session(self.rules, status, int(n), float(trust), whole(last_us), whole(due_us), [(t, float(v), float(d)) for t, v, d in self.last.get()] if self.last.exists() else [])

    def _store(self, s: Session) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if s.due_us is not None:
            self.handle.registerTimer(-(-s.due_us // 1000))  # the first millisecond not before it
        self.now.update((s.status, s.n, s.trust, s.last_us, s.due_us))
        self.last.put(s.signals)

    def _frame(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame([(key[0], *r) for r in rows], columns=[self.key, *NAMES])
        return frame.astype({"event_id": "Int64", "at_us": "int64", "n": "int64", "should": "bool"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        session, out = self._load(), []
        frame = pd.concat(list(rows)).sort_values(["at_us", "event_id"])
        none = lambda x: None if x is None or x != x else x
        for event_id, at_us, kind, value, drift in frame[["event_id", "at_us", "type", "value", "drift"]].itertuples(index=False):
            out += session.signal(int(event_id), int(at_us), none(kind), none(value), none(drift))
        self._store(session)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        session = self._load()
        out = session.silence(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self._store(session)
        if out:
            yield self._frame(key, out)

    def close(self) -> None:
        pass


def stream(events: DataFrame, key: str = "session_id", ts: str = "ts", late: str = "0 seconds", rules: Rules = Rules()) -> DataFrame:
    """The same rows from a stream, which needs the RocksDB state store; due times
    come once the watermark (``late`` behind the newest signal) has passed them."""
    rows = events.withWatermark(ts, late)
    flat = rows.where(F.col(key).isNotNull()).select(F.col(key), F.col("event_id").cast("long"), F.col(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"), F.col("type").cast("string"), F.col("value").cast("double"), F.col("drift").cast("double"))
    kind = events.schema[key].dataType.simpleString()
    return flat.groupBy(key).transformWithStateInPandas(statefulProcessor=_Machine(key, rules), outputStructType=f"{key} {kind}, {ROW}", outputMode="Append", timeMode="EventTime")
