"""Windows over ordered events of a key: velocity, travel, drift, decay, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.numbers import clamp, haversine_km


def _seconds(ts) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def velocity(events: DataFrame, key: str, ts: str = "ts", window: str = "1 hour", most: int = 10) -> DataFrame:
    """``key``, ``peak`` and ``attack``: whether some window of the given width,
    both ends included, holds more than ``most`` events.

    One shuffle on the key; the frame is a range, so a key's events are read once.
    """
    frame = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-_micros(window), 0)
    return events.where(F.col(ts).isNotNull()).select(key, F.count("*").over(frame).alias("c")).groupBy(key).agg(F.max("c").alias("peak")).withColumn("attack", F.col("peak") > most)


def _micros(window: str) -> int:
    n, unit = window.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000


def travel(events: DataFrame, key: str, lat: str = "lat", lon: str = "lon", ts: str = "ts", order: str = "event_id", km_h: float = 900.0, jitter_km: float = 5.0) -> DataFrame:
    """Each event with the distance, hours and speed from the one before it, and
    ``impossible``; steps without time, or under ``jitter_km``, never are."""
    w = Window.partitionBy(key).orderBy(ts, order)
    hours = (_seconds(ts) - F.lag(_seconds(ts)).over(w)) / 3600
    km = haversine_km(F.lag(lat).over(w), F.lag(lon).over(w), lat, lon)
    out = events.select("*", hours.alias("hours"), km.alias("km"))
    counts = (F.col("hours") > 0) & (F.col("km") >= jitter_km)
    return out.withColumn("speed", F.when(counts, F.col("km") / F.col("hours"))).withColumn("impossible", F.coalesce(F.col("speed") > km_h, F.lit(False)))


def ordered_values(events: DataFrame, key: str, value: str, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """A row for each key with ``values`` in order of time."""
    rows = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(ts, order, value))).alias("rows"))
    return rows.select(key, F.transform("rows", lambda r: r[value].cast("double")).alias("values"))


def ema(values, alpha: float = 0.3) -> Column:
    """Exponential moving average of an array, seeded by its first value, 0..1."""
    values = F.col(values) if isinstance(values, str) else values
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) > 0, clamp(F.aggregate(rest, F.element_at(values, 1), lambda s, v: F.lit(alpha) * v + F.lit(1 - alpha) * s)))


def trend(values, band: float = 0.02) -> Column:
    """Mean of the second half against the first: increasing, decreasing or stable."""
    values = F.col(values) if isinstance(values, str) else values
    half = F.greatest(F.lit(1), F.floor(F.size(values) / 2)).cast("int")
    avg = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    gap = avg(F.slice(values, half + 1, F.greatest(F.size(values) - half, F.lit(1)))) - avg(F.slice(values, 1, half))
    return F.when(F.size(values) < 2, "stable").when(gap > band, "increasing").when(gap < -band, "decreasing").otherwise("stable")


def shifts(events: DataFrame, key: str, value: str, ts: str = "ts", order: str = "event_id", back: int = 5, drop: float = 0.4, severe: float = 0.6) -> DataFrame:
    """Events whose value fell by more than ``drop`` under the mean of the
    ``back`` before them (all of which must be there)."""
    w = Window.partitionBy(key).orderBy(ts, order)
    before = w.rowsBetween(-back, -1)
    out = events.select("*", F.avg(value).over(before).alias("usual"), F.count(value).over(before).alias("_n"))
    fall = F.col("usual") - F.col(value)
    return out.where((F.col("_n") == back) & (fall > drop)).withColumn("severity", F.when(fall > severe, "critical").otherwise("high")).drop("_n")


def jumps(events: DataFrame, key: str, value: str, ts: str = "ts", order: str = "event_id", high: float = 0.3, severe: float = 0.5) -> DataFrame:
    """Events whose value differs from the last one by more than ``high``."""
    w = Window.partitionBy(key).orderBy(ts, order)
    step = F.abs(F.col(value) - F.lag(value).over(w))
    return events.select("*", step.alias("jump")).where(F.col("jump") > high).withColumn("severity", F.when(F.col("jump") > severe, "critical").otherwise("high"))


def device_switches(events: DataFrame, key: str, device: str, ts: str = "ts", order: str = "event_id", last: int = 5) -> DataFrame:
    """``key``, ``devices``: most distinct devices among any ``last`` events in a
    row, and ``switched``."""
    w = Window.partitionBy(key).orderBy(ts, order).rowsBetween(-(last - 1), 0)
    seen = events.where(F.col(device).isNotNull()).select(key, F.size(F.collect_set(device).over(w)).alias("n"))
    return seen.groupBy(key).agg(F.max("n").alias("devices")).withColumn("switched", F.col("devices") > 1)


def gaps(events: DataFrame, key: str, as_of: Column, ts: str = "ts", interval_s: float = 300.0) -> DataFrame:
    """``key``, ``idle_s`` since the last event, and ``overdue`` after three intervals."""
    idle = (F.unix_micros(as_of) - F.unix_micros(F.max(ts).cast("timestamp"))) / 1e6
    return events.groupBy(key).agg(idle.alias("idle_s")).withColumn("overdue", F.col("idle_s") > 3 * interval_s)


def worst_kind(events: DataFrame, key: str, kind: str, drift: str, ts: str = "ts", order: str = "event_id", last: int = 5) -> DataFrame:
    """The kind with the largest summed drift among a key's ``last`` events; ties
    go to the alphabetically first."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(order))
    recent = events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    sums = recent.groupBy(key, kind).agg(F.sum(drift).alias("s"))
    best = Window.partitionBy(key).orderBy(F.desc("s"), kind)
    return sums.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(key, F.col(kind).alias("worst"), F.col("s").alias("drift"))


def decayed(trust, hours, half_life: float = 24.0) -> Column:
    """trust * 0.5 ** (|hours| / half life), 0..1."""
    return clamp((F.col(trust) if isinstance(trust, str) else trust) * F.pow(F.lit(0.5), F.abs(hours) / half_life))


def transitions(events: DataFrame, key: str, status: str, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Events whose status differs from the last one of their key."""
    w = Window.partitionBy(key).orderBy(ts, order)
    return events.withColumn("previous", F.lag(status).over(w)).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(status)))


def latest_flags(events: DataFrame, key: str, flags: list[str], ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Last known value of each flag; a null leaves it as it was, unknown is false."""
    at = F.struct(ts, order)
    return events.groupBy(key).agg(*[F.coalesce(F.max_by(f, F.when(F.col(f).isNotNull(), at)), F.lit(False)).alias(f) for f in flags])


def progressions(events: DataFrame, key: str, level: str, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Events at which a key's level rose above all earlier ones."""
    w = Window.partitionBy(key).orderBy(ts, order)
    top = F.max(level).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("before", top).where(F.col("before").isNull() | (F.col(level) > F.col("before")))


def first_and_last(events: DataFrame, key: str, ts: str = "ts", trust: str | None = None) -> DataFrame:
    more = [F.min(trust).alias("trust")] if trust else []
    return events.groupBy(key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), *more)


def seen_before(rows: DataFrame, value: str, ts: str, order: str) -> DataFrame:
    """Adds ``earlier``: how many earlier rows have the same value (nulls none).

    A running count over the value, so no row is compared with all others.
    """
    w = Window.partitionBy(value).orderBy(ts, order)
    return rows.withColumn("earlier", F.when(F.col(value).isNull(), 0).otherwise(F.row_number().over(w) - 1))
