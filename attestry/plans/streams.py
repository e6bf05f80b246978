"""Queries over stateful streams: the session machine, deadlines, the relay."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.plans.common import SIGNALS_SQL, signals
from attestry.sources.shared import shared_folder
from attestry.sources.tables import read
from attestry.streaming import deadlines, relay, sessions

#: Signals of a user within three days are a session.
SPAN_US = 3 * 86_400_000_000
RULES = sessions.Rules(interval_s=6 * 3600.0)
KINDS = {"view": "face", "click": "voice", "purchase": "behavioral", "signup": "device", "error": "location"}


def _newest(events) -> int:
    return events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] or 0


def _sessions(spark, sf_dir):
    s = signals(spark, sf_dir)
    part = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / SPAN_US)
    drift = F.least(F.lit(1.0), F.col("value") / 97)  # no round decimals, which two roundings may take apart
    kind = F.lit(None).cast("string")
    for event, modality in KINDS.items():
        kind = F.when(F.col("event_type") == event, modality).otherwise(kind)
    return s.select(F.concat_ws("-", "user_id", part).alias("session_id"), "event_id", "ts", kind.alias("type"), (1 - drift).alias("value"), drift.alias("drift"))


def session_machine(spark, sf_dir):
    rows = _sessions(spark, sf_dir)
    out = sessions.batch(rows, _newest(rows), rules=RULES)
    return out.withColumn("drift", F.round("drift", 6)).withColumn("trust", F.round("trust", 6)).drop("trend")


def session_audit(spark, sf_dir):
    """The last entry of each session's trail, whose hash covers all before it."""
    trail = sessions.audit(_sessions(spark, sf_dir), rules=RULES)
    return trail.groupBy("session_id").agg(F.max("seq").alias("entries"), F.max_by("action", "seq").alias("action"), F.max_by("hash", "seq").alias("hash"))


def session_deadlines(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "error", "close").otherwise("touch")
    rows = e.select("user_id", "event_id", "ts", kind.alias("kind"))
    return deadlines.batch(rows, _newest(e), ttl_s=2 * 86_400, keep_s=5 * 86_400, key="user_id")


def outbox_relay(spark, sf_dir):
    """All events as an outbox stream; errors never get through."""
    folder = shared_folder(spark, "relay")
    events = read(spark, sf_dir, "events")
    e = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events[.]parquet")  # a pattern may be a file or a folder
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    rows = e.select("event_id", F.concat_ws("/", "user_id", day).alias("idempotency_key"), F.col("ts").alias("created_at"), F.col("event_type").alias("payload"))
    send = lambda claimed: claimed.select("event_id", (F.col("payload") != "error").alias("ok"))
    r = relay.Relay(folder, send, claim=None)
    r.writer(rows, f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    r.settle(spark, rows.schema)
    done = r.table(spark, "log", rows.schema).unionByName(r.table(spark, "dead", rows.schema))
    return done.select("event_id", "idempotency_key", "attempts", "status")


_KIND_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in KINDS.items()) + " end"
_MODALITY_SQL = "case kind when 'location' then 'device' else coalesce(kind, 'face') end"
QUERIES = {
    "session_machine": (
        session_machine,
        f"""with {SIGNALS_SQL},
        s as (select user_id || '-' || (epoch_us(ts) // {SPAN_US}) session_id, event_id, epoch_us(ts) us, {_KIND_SQL} kind, least(1.0::double, greatest(0.0::double, value / 97.0::double)) d from signals),
        l as (select *, row_number() over w i, list(d) over (w rows between 99 preceding and current row) ds, lead(us) over w next from s window w as (partition by session_id order by us, event_id)),
        m as (select *, list_reduce(ds, lambda a, x: 0.3::double * x + 0.7::double * a) ema from l),
        r as (select *, min(case when ema >= 0.4 then i end) over (partition by session_id) dead from m),
        c as (select *, case when i = dead then 'revoked' when ema >= 0.15 then 'reverify' else 'active' end status from r where dead is null or i <= dead),
        p as (select *, lag(status) over (partition by session_id order by i) was from c),
        k as (select a.session_id, a.i, b.kind, sum(b.d) total, min(b.i) first from r a join r b on a.session_id = b.session_id and b.i between a.i - 4 and a.i group by 1, 2, 3),
        q as (select session_id, i, first({_MODALITY_SQL} order by total desc, first) worst from k group by 1, 2),
        o as (
          select session_id, event_id, us at_us, case when i = dead then 'session_revoked' when coalesce(was, 'active') = 'active' and status = 'reverify' then 'reverify_flagged' when was = 'reverify' and status = 'active' then 'reverify_cleared' else 'signal_recorded' end "action", status, i, ema, len(ds) k, status = 'revoked' x, false due from p
          union all select session_id, null, us + {round(RULES.interval_s * 1e6)}, 'reverify_due', status, i, ema, len(ds), false, true from p where (dead is null or i < dead) and coalesce(next, (select max(epoch_us(ts)) from events)) >= us + {round(RULES.interval_s * 1e6)}
          union all select e.session_id, e.event_id, e.us, 'error', 'revoked', d.i, d.ema, len(d.ds), true, false from r e join r d on e.session_id = d.session_id and d.i = d.dead where e.i > e.dead)
        select session_id, event_id, at_us, "action", status, i n, case when x then 0.0::double else 1.0::double end trust, round(ema, 6) drift, least(1.0::double, k / 10.0::double) confidence, x or ema >= 0.15 or due or i < 3 should,
          case when x then 'revoked' when ema >= 0.15 then 'drift' when due then 'interval' when i < 3 then 'few_signals' end reason, case when x then 'face' when ema >= 0.15 or due then worst when i < 3 then 'behavioral' else 'face' end modality
        from o join q using (session_id, i)""",
    ),
    "session_audit": (session_audit, None),
    "session_deadlines": (
        session_deadlines,
        """with e as (select user_id, event_id, epoch_us(ts) us, event_type k from events), f as (select user_id, min(us) us from e where k = 'signup' group by 1),
        g as (select user_id, arg_min(event_id, event_id) event_id, f.us from e join f using (user_id) where e.us = f.us and k = 'signup' group by user_id, f.us),
        j as (select e.*, g.us o, g.event_id oid, row_number() over (partition by e.user_id order by e.us, e.event_id) i from e left join g using (user_id)),
        h as (select j.*, (select min(i) from j s where s.user_id = j.user_id and s.k = 'error' and s.us <= s.o + 172800000000 and (s.us > s.o or s.us = s.o and s.event_id > s.oid)) stop from j)
        select user_id, event_id, us at_us, case when o is null or us < o or us = o and event_id < oid then 'unknown' when event_id = oid then 'opened' when us > o + 604800000000 then 'unknown' when i > stop then 'ended' when us > o + 172800000000 then 'expired' when i = stop then 'closed' else 'active' end answer from h
        union all select user_id, null, us + 172800000000, 'deadline' from h where event_id = oid and stop is null and us + 172800000000 < (select max(epoch_us(ts)) from events)""",
    ),
    "outbox_relay": (
        outbox_relay,
        "select event_id, user_id || '/' || (epoch_us(ts) // 86400000000) idempotency_key, case when event_type = 'error' then 5 else 1 end attempts, case when event_type = 'error' then 'dead_letter' else 'processed' end status from events qualify row_number() over (partition by user_id, epoch_us(ts) // 86400000000 order by ts, event_id) = 1",
    ),
}
