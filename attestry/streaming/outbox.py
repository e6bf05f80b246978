"""Transactional outbox, idempotent projection, webhooks, fencing and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deduplicated(events: DataFrame, key: str = "idempotency_key", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """The first event of each key; a stream needs a watermark on ``ts``."""
    if events.isStreaming:
        return events.dropDuplicatesWithinWatermark([key])
    w = Window.partitionBy(key).orderBy(ts, order)
    return events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def claimable(outbox: DataFrame, n: int = 50, most_attempts: int = 5) -> DataFrame:
    """The oldest pending or retryable rows, to be relayed next."""
    open_ = outbox.where(F.col("status").isin("pending", "failed") & (F.col("attempts") < most_attempts))
    return open_.orderBy("created_at", "event_id").limit(n)


def settled(outbox: DataFrame, results: DataFrame, most_attempts: int = 5) -> DataFrame:
    """The outbox after a relay: processed, failed or dead_letter."""
    r = results.select("event_id", F.col("ok"))
    out = outbox.join(r, "event_id", "left")
    tries = F.col("attempts") + F.col("ok").isNotNull().cast("int")
    status = F.when(F.col("ok").isNull(), F.col("status")).when(F.col("ok"), "processed").when(tries >= most_attempts, "dead_letter").otherwise("failed")
    return out.withColumn("status", status).withColumn("attempts", tries).drop("ok")


def project(events: DataFrame, log: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """Events that the log has not seen."""
    return deduplicated(events, key).join(log.select(key), key, "left_anti")


def lag_seconds(events: DataFrame, log: DataFrame, ts: str = "ts") -> DataFrame:
    a, b = events.agg(F.max(ts).alias("a")), log.agg(F.max(ts).alias("b"))
    return a.crossJoin(b).select(((F.unix_micros(F.col("a").cast("timestamp")) - F.unix_micros(F.col("b").cast("timestamp"))) / 1e6).alias("lag_s"))


def _wanted(endpoints: DataFrame, kind: str) -> DataFrame:
    """The kinds that each active endpoint subscribes to, one a row."""
    return endpoints.where("active").select("endpoint_id", F.explode("events").alias(kind)).distinct()


def fan_out(events: DataFrame, endpoints: DataFrame, kind: str = "event_type") -> DataFrame:
    """A row for each event and active endpoint that subscribes to its kind.

    Endpoints are exploded by kind, so this is an equi-join.
    """
    return events.join(_wanted(endpoints, kind), kind)


def fan_out_counts(events: DataFrame, endpoints: DataFrame, kind: str = "event_type") -> DataFrame:
    """How many rows ``fan_out`` has for each endpoint, ``n``, without making them.

    Events are counted by kind before they meet the endpoints, so the join has a
    row for each subscription, not one for each delivery.
    """
    counts = events.groupBy(kind).agg(F.count("*").alias("n"))
    return counts.join(_wanted(endpoints, kind), kind).groupBy("endpoint_id").agg(F.sum("n").alias("n"))


def fenced(events: DataFrame, epochs: DataFrame, writer: str = "writer", epoch: str = "epoch") -> DataFrame:
    """Events of writers that hold the current epoch."""
    return events.join(epochs.select(writer, F.col(epoch).alias("_current")), writer).where(F.col(epoch) == F.col("_current")).drop("_current")


def expired(sessions: DataFrame, as_of: Column, minutes: int = 30, created: str = "created_at") -> DataFrame:
    """Sessions so many minutes after their creation, whatever happened since."""
    return sessions.where(as_of >= F.col(created) + F.make_interval(mins=F.lit(minutes)))


def due(requests: DataFrame, as_of: Column, days: int = 30, ts: str = "ts") -> DataFrame:
    return requests.where(as_of >= F.col(ts) + F.make_interval(days=F.lit(days)))


def windowed_counts(events: DataFrame, key: str, ts: str = "ts", width: str = "1 hour", slide: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Sliding counts for batch or stream, late rows dropped by watermark."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width, slide).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
