"""Keyed folds over ordered events, for batch and stream alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_NOTHING = object()

#: (state, event) -> (state, answer); an event has ``at`` in seconds and ``value``.
Fold = Callable[[dict[str, Any], dict[str, Any]], tuple[dict[str, Any], dict[str, Any]]]


def anchored_velocity(window_s: float = 3600.0, critical: int = 20, warning: int = 14) -> Fold:
    """Counts within a window that starts at its first event and starts anew at
    the first event after its end."""

    def step(state: dict, event: dict) -> tuple[dict, dict]:
        at = event["at"]
        if state.get("start") is None or at - state["start"] > window_s:
            state = {"start": at, "n": 0}
        state["n"] += 1
        level = "critical" if state["n"] > critical else "warning" if state["n"] > warning else "ok"
        return state, {"n": state["n"], "level": level}

    return step


def fixed_window(limit: int, window_s: float = 60.0) -> Fold:
    """Accepts ``limit`` events, then none until the window's end has passed."""

    def step(state: dict, event: dict) -> tuple[dict, dict]:
        at = event["at"]
        if state.get("end") is None or state["end"] < at:
            state = {"end": at + window_s, "n": 0}
        state["n"] += 1
        return state, {"n": state["n"], "level": "accepted" if state["n"] <= limit else "rejected"}

    return step


def sliding_log(limit: int, window_s: float = 60.0) -> Fold:
    """Accepts an event if fewer than ``limit`` were accepted in the last window;
    rejected ones leave no trace."""

    def step(state: dict, event: dict) -> tuple[dict, dict]:
        at = event["at"]
        log = [t for t in state.get("log", []) if at - t < window_s]
        ok = len(log) < limit
        if ok:
            log.append(at)
        return {"log": log}, {"n": len(log), "level": "accepted" if ok else "rejected"}

    return step


def session_machine(alpha: float = 0.3, revoke: float = 0.40, reverify: float = 0.15) -> Fold:
    """Drift of a session as a moving average; revoked is final, and events after
    it are errors."""

    def step(state: dict, event: dict) -> tuple[dict, dict]:
        if state.get("status") == "revoked":
            return state, {"n": state["n"], "level": "error"}
        drift = min(1.0, max(0.0, float(event["value"])))
        ema = drift if state.get("ema") is None else alpha * drift + (1 - alpha) * state["ema"]
        status = "revoked" if ema >= revoke else "reverify" if ema >= reverify else "active"
        state = {"ema": ema, "status": status, "n": state.get("n", 0) + 1}
        return state, {"n": state["n"], "level": status}

    return step


def breaker(threshold: int = 5, rest_s: float = 30.0, probes: int = 2) -> Fold:
    """Circuit breaker replayed over calls; ``value`` > 0 is a success."""

    def step(state: dict, event: dict) -> tuple[dict, dict]:
        at, ok = event["at"], float(event["value"]) > 0
        s = {"mode": "closed", "fails": 0, "good": 0, "since": 0.0, **state}
        if s["mode"] == "open":
            if at - s["since"] < rest_s:
                return s, {"n": s["fails"], "level": "open"}
            s |= {"mode": "half_open", "good": 0}
        if ok:
            s["good"] += 1
            if s["mode"] == "half_open" and s["good"] >= probes:
                s |= {"mode": "closed", "fails": 0}
            elif s["mode"] == "closed":
                s["fails"] = 0
        else:
            s["fails"] += 1
            if s["mode"] == "half_open" or s["fails"] >= threshold:
                s |= {"mode": "open", "since": at}
        return s, {"n": s["fails"], "level": s["mode"]}

    return step


def delivery(most: int = 3) -> Fold:
    """Webhook attempts: delivered, retry, or dead letter after ``most`` failures;
    a later success delivers from the dead letters too."""

    def step(state: dict, event: dict) -> tuple[dict, dict]:
        n = state.get("n", 0) + 1
        status = "delivered" if float(event["value"]) > 0 else "dead_letter" if n >= most else "retry"
        return {"n": n}, {"n": n, "level": status}

    return step


def _timed(events: DataFrame, key: str, order: str) -> DataFrame:
    """Events with their time in seconds (``at``)."""
    return events.select(key, (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), order, "value")


def in_order(rows: DataFrame, key: str, order: list[str], names: list[str], step: Callable[[dict[str, Any], dict[str, Any]], tuple[dict[str, Any], tuple]], schema: str) -> DataFrame:
    """``step(state, row)`` along each key's order, a row out for each row in.

    A partition is sorted by key and order and read batch by batch, so no key is
    ever held as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: Any = _NOTHING
        state: dict[str, Any] = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != last:
                    last, state = row[key], {}
                state, answer = step(state, row)
                out.append(answer)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, zip(*out, strict=True), strict=True)], names) if out else pa.RecordBatch.from_arrays([pa.array([], kinds[n]) for n in names], names)

    kinds = {f.name: to_arrow_type(f.dataType) for f in T.StructType.fromDDL(schema)}
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def batch(events: DataFrame, key: str, fold: Fold, order: str = "event_id") -> DataFrame:
    """``key``, ``event_id``, ``n``, ``level`` for each event."""

    def step(state: dict, event: dict) -> tuple[dict, tuple]:
        state, out = fold(state, event)
        return state, (event[key], event[order], out["n"], out["level"])

    kind, order_kind = (events.schema[c].dataType.simpleString() for c in (key, order))
    return in_order(_timed(events, key, order), key, ["at", order], [key, order, "n", "level"], step, f"{key} {kind}, {order} {order_kind}, n long, level string")


class _Processor(StatefulProcessor):
    def __init__(self, key: str, order: str, fold: Fold):
        self.key, self.order, self.fold = key, order, fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        import json

        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        frame = pd.concat(list(rows))
        out = []
        for event in frame.sort_values(["at", self.order]).to_dict("records"):
            state, answer = self.fold(state, event)
            out.append((key[0], event[self.order], answer["n"], answer["level"]))
        self.state.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=[self.key, self.order, "n", "level"])

    def close(self) -> None:
        pass


def stream(events: DataFrame, key: str, fold: Fold, order: str = "event_id") -> DataFrame:
    """The same for a stream; needs the RocksDB state store."""
    kind, order_kind = (events.schema[c].dataType.simpleString() for c in (key, order))
    return (
        _timed(events, key, order)
        .groupBy(key)
        .transformWithStateInPandas(statefulProcessor=_Processor(key, order, fold), outputStructType=f"{key} {kind}, {order} {order_kind}, n long, level string", outputMode="Append", timeMode="None")
    )
