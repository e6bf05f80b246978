"""Queries over ordered events: velocity, travel, drift, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions.numbers import half_up
from attestry.operators import series
from attestry.plans.common import SIGNALS_SQL, signals
from attestry.sources.tables import read
from attestry.streaming import folds


def velocity_attack(spark, sf_dir):
    return series.velocity(read(spark, sf_dir, "events"), "user_id", window="6 hour", most=3)


def velocity_timeline(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return events.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))


def impossible_travel(spark, sf_dir):
    out = series.travel(signals(spark, sf_dir), "user_id")
    return out.where("impossible").select("user_id", "event_id", F.round("km", 3).alias("km"), F.round("hours", 6).alias("hours"))


def ema_drift(spark, sf_dir):
    v = series.ordered_values(signals(spark, sf_dir), "user_id", "drift")
    return v.select("user_id", F.round(series.ema("values"), 6).alias("ema"))


def drift_trend(spark, sf_dir):
    v = series.ordered_values(signals(spark, sf_dir), "user_id", "drift")
    return v.select("user_id", series.trend("values").alias("trend"), F.size("values").cast("long").alias("n"))


def behavioral_shift(spark, sf_dir):
    return series.shifts(signals(spark, sf_dir), "user_id", "drift").select("user_id", "event_id", F.round("usual", 6).alias("usual"), "severity")


def sudden_drift(spark, sf_dir):
    return series.jumps(signals(spark, sf_dir), "user_id", "drift").select("user_id", "event_id", F.round("jump", 6).alias("jump"), "severity")


def device_switch(spark, sf_dir):
    return series.device_switches(signals(spark, sf_dir), "user_id", "k").select("user_id", F.col("devices").cast("long").alias("devices"), "switched")


def gap_detection(spark, sf_dir):
    out = series.gaps(read(spark, sf_dir, "events"), "user_id", F.lit("2024-02-01").cast("timestamp"), interval_s=20_000)
    return out.select("user_id", F.round("idle_s", 3).alias("idle_s"), "overdue")


def worst_modality(spark, sf_dir):
    return series.worst_kind(signals(spark, sf_dir), "user_id", "event_type", "drift").select("user_id", "worst", F.round("drift", 6).alias("drift"))


def trust_decay(spark, sf_dir):
    last = signals(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("ts"), F.avg("drift").alias("d"))
    hours = (F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    return last.select("user_id", F.round(series.decayed(1 - F.col("d"), hours), 6).alias("trust"))


def alert_transitions(spark, sf_dir):
    return series.transitions(read(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", "event_id", "previous", F.col("event_type").alias("status"))


def consent_state(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    flags = e.withColumn("marketing", F.when(F.col("event_type") == "signup", F.col("value") > 20)).withColumn("sharing", F.when(F.col("event_type") == "click", F.col("value") > 50))
    return series.latest_flags(flags, "user_id", ["marketing", "sharing"])


def tier_progression(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("tier", F.floor(F.least(F.col("value"), F.lit(400.0)) / 80))
    return series.progressions(e, "user_id", "tier").select("user_id", "event_id", "tier", "before")


def first_last_seen(spark, sf_dir):
    return series.first_and_last(signals(spark, sf_dir), "user_id").select("user_id", F.unix_micros(F.col("first_seen").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_seen").cast("timestamp")).alias("last_us"))


def session_steps(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("s"))
    return rows.select("user_id", F.array_join(F.array_distinct("s"), ">").alias("steps"))


def anchored_velocity(spark, sf_dir):
    return folds.batch(read(spark, sf_dir, "events"), "user_id", folds.anchored_velocity(window_s=86_400, critical=5, warning=3))


def fixed_window_limiter(spark, sf_dir):
    return folds.batch(read(spark, sf_dir, "events"), "user_id", folds.fixed_window(3, 86_400.0))


def sliding_log_limiter(spark, sf_dir):
    return folds.batch(read(spark, sf_dir, "events"), "user_id", folds.sliding_log(3, 86_400.0))


def auth_session_machine(spark, sf_dir):
    return folds.batch(signals(spark, sf_dir).drop("value").withColumnRenamed("drift", "value"), "user_id", folds.session_machine())


def circuit_breaker(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_type") == "error", 0.0).otherwise(1.0))
    return folds.batch(e, "user_id", folds.breaker(threshold=2, rest_s=86_400, probes=1))


def _fold(first: str, then: str) -> str:
    """State along each user's events; e is the event, r the last state."""
    return (
        f"with recursive {SIGNALS_SQL}, e as (select user_id, event_id, epoch_us(ts) / 1000000.0::double t, drift d, event_type <> 'error' ok, row_number() over (partition by user_id order by ts, event_id) i from signals), "
        f"r as (select user_id, event_id, i, {first} from e where i = 1 union all select e.user_id, e.event_id, e.i, {then} from r join e on e.user_id = r.user_id and e.i = r.i + 1) "
    )


_BY = "partition by user_id order by ts, event_id"
QUERIES = {
    "velocity_attack": (velocity_attack, "select user_id, max(c) peak, max(c) > 3 attack from (select user_id, count(*) over (partition by user_id order by ts range between interval 6 hours preceding and current row) c from events) group by user_id"),
    "velocity_timeline": (velocity_timeline, "select user_id, date_trunc('day', ts)::timestamp as day, count(*) n from events group by 1, 2"),
    "impossible_travel": (
        impossible_travel,
        f"""with {SIGNALS_SQL}, p as (select user_id, event_id, lat, lon, lag(lat) over w lat0, lag(lon) over w lon0, (epoch_us(ts) - epoch_us(lag(ts) over w)) / 3600000000.0::double as hours from signals window w as ({_BY})),
        d as (select *, 12742.0::double * asin(least(1.0::double, sqrt(pow(sin((radians(lat) - radians(lat0)) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(lon0)) / 2), 2)))) km from p)
        select user_id, event_id, round(km, 3) km, round(hours, 6) as hours from d where hours > 0 and km >= 5 and km / hours > 900""",
    ),
    "ema_drift": (ema_drift, f"with {SIGNALS_SQL} select user_id, round(list_reduce(list(drift order by ts, event_id), lambda a, x: 0.3::double * x + 0.7::double * a), 6) ema from signals group by user_id"),
    "drift_trend": (
        drift_trend,
        f"""with {SIGNALS_SQL}, r as (select user_id, drift, row_number() over ({_BY}) i, count(*) over (partition by user_id) n from signals),
        h as (select user_id, n, avg(drift) filter (i > greatest(1, n // 2)) - avg(drift) filter (i <= greatest(1, n // 2)) gap from r group by 1, 2)
        select user_id, case when n < 2 then 'stable' when gap > 0.02 then 'increasing' when gap < -0.02 then 'decreasing' else 'stable' end trend, n from h""",
    ),
    "behavioral_shift": (
        behavioral_shift,
        f"""with {SIGNALS_SQL}, r as (select *, avg(drift) over w usual, count(drift) over w n from signals window w as ({_BY} rows between 5 preceding and 1 preceding))
        select user_id, event_id, round(usual, 6) usual, case when usual - drift > 0.6 then 'critical' else 'high' end severity from r where n = 5 and usual - drift > 0.4""",
    ),
    "sudden_drift": (sudden_drift, f"with {SIGNALS_SQL}, r as (select *, abs(drift - lag(drift) over ({_BY})) jump from signals) select user_id, event_id, round(jump, 6) jump, case when jump > 0.5 then 'critical' else 'high' end severity from r where jump > 0.3"),
    "device_switch": (device_switch, f"with {SIGNALS_SQL}, r as (select user_id, len(list_distinct(list(k) over ({_BY} rows between 4 preceding and current row))) n from signals) select user_id, max(n)::bigint devices, max(n) > 1 switched from r group by user_id"),
    "gap_detection": (gap_detection, "select user_id, round((epoch_us(timestamp '2024-02-01') - epoch_us(max(ts))) / 1000000.0::double, 3) idle_s, (epoch_us(timestamp '2024-02-01') - epoch_us(max(ts))) / 1000000.0::double > 60000 overdue from events group by user_id"),
    "worst_modality": (
        worst_modality,
        f"""with {SIGNALS_SQL}, r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) i from signals), s as (select user_id, event_type, sum(drift) d from r where i <= 5 group by 1, 2)
        select user_id, event_type worst, round(d, 6) drift from (select *, row_number() over (partition by user_id order by d desc, event_type) i from s) where i = 1""",
    ),
    "trust_decay": (
        trust_decay,
        f"with {SIGNALS_SQL} select user_id, round(greatest(0.0::double, least(1.0::double, (1 - avg(drift)) * pow(0.5::double, abs((epoch_us(timestamp '2024-02-01') - epoch_us(max(ts))) / 3600000000.0::double) / 24.0::double))), 6) trust from signals group by user_id",
    ),
    "alert_transitions": (alert_transitions, f"select user_id, event_id, previous, event_type status from (select *, lag(event_type) over ({_BY}) previous from events) where previous <> event_type"),
    "consent_state": (
        consent_state,
        "select user_id, coalesce(arg_max(value > 20, (ts, event_id)) filter (event_type = 'signup'), false) marketing, coalesce(arg_max(value > 50, (ts, event_id)) filter (event_type = 'click'), false) sharing from events group by user_id",
    ),
    "tier_progression": (
        tier_progression,
        f"with t as (select *, floor(least(value, 400.0::double) / 80)::bigint tier from events), r as (select *, max(tier) over ({_BY} rows between unbounded preceding and 1 preceding) before from t) select user_id, event_id, tier, before from r where before is null or tier > before",
    ),
    "first_last_seen": (first_last_seen, "select user_id, epoch_us(min(ts)) first_us, epoch_us(max(ts)) last_us from events group by user_id"),
    "session_steps": (session_steps, "with f as (select user_id, event_type, min((ts, event_id)) f from events group by 1, 2) select user_id, string_agg(event_type, '>' order by f) steps from f group by 1"),
    "anchored_velocity": (
        anchored_velocity,
        _fold("t s, 1 n", "case when e.t - r.s > 86400 then e.t else r.s end, case when e.t - r.s > 86400 then 1 else r.n + 1 end") + "select user_id, event_id, n::bigint n, case when n > 5 then 'critical' when n > 3 then 'warning' else 'ok' end as level from r",
    ),
    "fixed_window_limiter": (fixed_window_limiter, _fold("t + 86400 s, 1 n", "case when r.s < e.t then e.t + 86400 else r.s end, case when r.s < e.t then 1 else r.n + 1 end") + "select user_id, event_id, n::bigint n, case when n <= 3 then 'accepted' else 'rejected' end as level from r"),
    "sliding_log_limiter": (
        sliding_log_limiter,
        _fold("[t] log, true ok", "case when len(list_filter(r.log, lambda x: e.t - x < 86400)) < 3 then list_append(list_filter(r.log, lambda x: e.t - x < 86400), e.t) else list_filter(r.log, lambda x: e.t - x < 86400) end, len(list_filter(r.log, lambda x: e.t - x < 86400)) < 3")
        + "select user_id, event_id, len(log)::bigint n, case when ok then 'accepted' else 'rejected' end as level from r",
    ),
    "auth_session_machine": (
        auth_session_machine,
        _fold("least(1.0::double, greatest(0.0::double, d)) a, 1 n, false gone", "case when r.a >= 0.4 then r.a else 0.3::double * least(1.0::double, greatest(0.0::double, e.d)) + (1 - 0.3::double) * r.a end, case when r.a >= 0.4 then r.n else r.n + 1 end, r.a >= 0.4")
        + "select user_id, event_id, n::bigint n, case when gone then 'error' when a >= 0.4 then 'revoked' when a >= 0.15 then 'reverify' else 'active' end as level from r",
    ),
    "circuit_breaker": (
        circuit_breaker,
        # Two failures open it for a day; then one success closes it and one failure opens it anew.
        _fold(
            "case when ok then 'closed' else 'closed' end m, case when ok then 0 else 1 end f, 0.0::double s",
            """case when r.m = 'open' and e.t - r.s < 86400 then 'open' when r.m = 'open' then case when e.ok then 'closed' else 'open' end when e.ok then 'closed' when r.f + 1 >= 2 then 'open' else 'closed' end,
            case when r.m = 'open' and e.t - r.s < 86400 then r.f when e.ok then 0 else r.f + 1 end, case when r.m = 'open' and e.t - r.s < 86400 then r.s when not e.ok and (r.m = 'open' or r.f + 1 >= 2) then e.t else r.s end""",
        )
        + "select user_id, event_id, f::bigint n, m as level from r",
    ),
}
