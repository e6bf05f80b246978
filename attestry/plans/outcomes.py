"""Queries over decisions, certificates and deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import fusion, outcomes, risk
from attestry.plans.common import SIGNALS_SQL, signals
from attestry.plans.risk import _cases
from attestry.sources.tables import read


def decisions(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    result = lambda m: F.when(k % m == 0, "fail").otherwise("pass")
    item = lambda c, r: F.struct(F.lit(c).alias("check"), r.alias("result"))
    e = F.array(item("MRZ_digits", result(7)), item("cross_field_name", result(11)), item("chip_read", F.when(k % 5 == 0, "pass").otherwise("not_performed")), item("print_quality", result(4)))
    rows = o.select("o_orderkey", e.alias("evidence"), F.when(k % 6 > 0, k % 10 / 10).alias("live"), (k % 13 == 0).alias("unsupported"), (k % 17 == 0).alias("expired"), (k % 9 / 8).alias("sure"))
    return rows.select("o_orderkey", outcomes.decision("evidence", "live", "unsupported", "expired", "sure").alias("d")).select("o_orderkey", "d.*")


def fused_modalities(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    part = lambda m: k % m / (m - 1.0)
    given = {n: (F.when(k % (i + 3) > 0, part(7 + i)), part(11 + i)) for i, n in enumerate(("face", "voice", "behavioral", "document", "device"))}
    risk = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (k % 3 + 1).cast("int"))
    rows = p.withColumns({"risk": risk, "device_type": F.when(k % 2 == 0, "mobile").otherwise("desktop"), "session_age": (k % 50 * 20).cast("double")})
    w = rows.select("p_partkey", outcomes.fused(given, fusion.weights()).alias("f"))
    return w.select("p_partkey", F.round("f.score", 6).alias("score"), F.round("f.conflict", 6).alias("conflict"), "f.decision", F.col("f.count").cast("long").alias("n"), F.array_join("f.missing", ",").alias("missing"))


#: Signals in the order that the steps list them.
STEP_SIGNALS = ("document_authenticity", "ocr_confidence", "cross_field_consistency", "face_match_confidence", "liveness_confidence", "device_signals", "ai_consensus_confidence")


def decision_steps(spark, sf_dir):
    """The written steps of each order's decision."""
    rows = _cases(spark, sf_dir).select("o_orderkey", risk.signals().alias("s"), risk.evaluate().alias("r"))
    text = outcomes.written_steps({n: F.col("s")[n] for n in STEP_SIGNALS}, F.col("r"))
    return rows.select("o_orderkey", text.alias("steps"))


def face_matches(spark, sf_dir):
    """Each vector against the next one, with the qualities of both."""
    v = read(spark, sf_dir, "embeddings")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    rows = v.select("vec_id", F.col("embedding").alias("a")).join(nxt, "vec_id")
    cos = F.round(dot(F.col("a"), F.col("b")) / F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b"))), 6)
    q = lambda n: F.col("vec_id") % n / (n - 1)
    return rows.select("vec_id", cos.alias("similarity"), outcomes.face_decision(cos, q(11), q(5)).alias("d")).select("vec_id", "similarity", "d.*")


def certificates(spark, sf_dir):
    """Certificates of customers, some forged, judged on one day."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    issued = F.timestamp_seconds(F.lit(1_704_067_200) + k % 200 * 86_400)
    rows = c.select("c_custkey", F.struct("c_name", "c_custkey", F.array("c_mktsegment").alias("tags")).alias("payload"), issued.alias("issued"))
    made = outcomes.certified(rows, "payload", "issued", "secret")
    forged = made.withColumn("body", F.when(k % 10 == 3, F.replace("body", F.lit("Customer"), F.lit("Someone"))).otherwise(F.col("body")))
    out = outcomes.certificate_state(forged, "secret", F.lit("2024-07-01 00:00:00").cast("timestamp"))
    return out.select("c_custkey", F.md5(F.col("body").cast("binary")).alias("body"), "state")


def webhook_attempts(spark, sf_dir):
    """Events by three outcomes, and three more for those replayed a day later."""
    e, n = read(spark, sf_dir, "events"), F.col("event_id")
    ok = F.array(*[n % m == 0 for m in (3, 5, 7, 2, 11, 13)])
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = e.select("event_id", "user_id", at.alias("created_us"), ok.alias("outcomes"), F.when(n % 4 == 1, at + 86_400_000_000).alias("replayed_us"))
    return outcomes.delivered(rows, replayed="replayed_us").select("event_id", "status", "attempts", "ended_us")


def webhook_failures(spark, sf_dir):
    e, n = read(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select("event_id", "user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("created_us"), F.array(*[n % m == 0 for m in (5, 7, 11)]).alias("outcomes"))
    return outcomes.endpoint_failures(outcomes.delivered(rows), "user_id", ["ts", "event_id"])


def latest_devices(spark, sf_dir):
    return outcomes.latest_devices(signals(spark, sf_dir), "user_id", "k")


_A = outcomes.ADVICE
_STATUS = """case when k % 13 = 0 then 'UNSUPPORTED_DOCUMENT' when k % 11 = 0 then 'DOCUMENT_MISMATCH' when k % 7 = 0 then 'INVALID_STRUCTURE' when k % 17 = 0 then 'EXPIRED' when k % 6 > 0 and k % 10 < 6 then 'LIVENESS_INCONCLUSIVE'
  when k % 5 = 0 then 'ELECTRONIC_AUTHENTICATION_PASSED' when k % 4 <> 0 then 'VERIFIED_WITH_SUPPORTED_EVIDENCE' else 'STRUCTURE_VALID_BUT_AUTHENTICITY_UNCONFIRMED' end"""
_TEXT = {s: "'" + t.replace("'", "''") + "'" for s, t in _A.items()}
_NAMES = "concat_ws(', ', case when k % 7 = 0 then 'MRZ_digits' end, case when k % 11 = 0 then 'cross_field_name' end)"
_ADVISED = "case status " + " ".join(f"when '{s}' then " + (f"replace({t}, '{{0}}', {_NAMES})" if s in ("DOCUMENT_MISMATCH", "INVALID_STRUCTURE") else f"replace(replace({t}, '{{0}}', '0.' || k % 10 || '0'), '{{1}}', '0.6')" if s == "LIVENESS_INCONCLUSIVE" else t) for s, t in _TEXT.items()) + " end"
QUERIES = {
    "decisions": (
        decisions,
        f"""with k as (select o_orderkey k from orders), s as (select k, {_STATUS} status from k)
        select k o_orderkey, status, {_ADVISED} recommendation, status in ('UNSUPPORTED_DOCUMENT', 'DOCUMENT_MISMATCH', 'INVALID_STRUCTURE', 'LIVENESS_INCONCLUSIVE') or status = 'STRUCTURE_VALID_BUT_AUTHENTICITY_UNCONFIRMED' and k % 9 / 8.0::double < 0.65 human_review from s""",
    ),
    "fused_modalities": (
        fused_modalities,
        """with recursive n as (select unnest(['face', 'voice', 'behavioral', 'document', 'device']) name, unnest(range(5)) j),
        g as (select p_partkey k, name, j, p_partkey % (7 + j) / (6.0::double + j) s, p_partkey % (11 + j) / (10.0::double + j) c from part, n where p_partkey % (j + 3) > 0),
        e as (select k, row_number() over (partition by k order by j) i, s >= 0.5 good, greatest(s, 1 - s) p, 1 - c u0 from g),
        m as (select k, i, case when good then p else 1 - p - least(u0, 1 - p) end r, case when good then 1 - p - least(u0, 1 - p) else p end f, least(u0, 1 - p) u from e),
        d as (select k, i, r, f, u, 0.0::double x from m where i = 1 union all
          select k, i, case when z > 1e-9 then a / z else 0.5 end, case when z > 1e-9 then b / z else 0.5 end, case when z > 1e-9 then c / z else 0 end, case when z > 1e-9 then x else 1 end
          from (select m.k, m.i, d.r * m.r + d.r * m.u + d.u * m.r a, d.f * m.f + d.f * m.u + d.u * m.f b, d.u * m.u c, d.r * m.f + d.f * m.r x, a + b + c z from d join m on m.k = d.k and m.i = d.i + 1)),
        o as (select k, arg_max(r / (r + f + u), i) score, arg_max(x, i) conflict, max(i) n from d group by 1),
        w as (select p_partkey k, string_agg(name, ',' order by j) missing from part, n where p_partkey % (j + 3) = 0 group by 1)
        select p_partkey, round(coalesce(score, 0), 6) score, round(coalesce(conflict, 0), 6) "conflict", case when score >= 0.7 and conflict < 0.3 then 'approve' when score is null or score < 0.4 or conflict > 0.6 then 'reject' else 'review' end decision, coalesce(n, 0) n, coalesce(missing, '') missing
        from part left join o on o.k = p_partkey left join w on w.k = p_partkey""",
    ),
    "decision_steps": (decision_steps, None),
    "face_matches": (
        face_matches,
        """with p as (select a.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[], b.embedding::double[])), 6) s from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
        t as (select *, 0.36::double + (1.0::double - least(vec_id % 11 / 10.0::double, vec_id % 5 / 4.0::double)) * 0.06::double t from p)
        select vec_id, s similarity, s >= t as match, round(t, 4) threshold, case when s < 0.1 then 'no_face_match' when s >= t then 'match' else 'below_threshold' end reason from t""",
    ),
    "certificates": (
        certificates,
        """with c as (select *, timestamp '2024-01-01' + to_days((c_custkey % 200)::int) i from customer)
        select c_custkey, md5('{"expiresAt":"' || strftime(i + to_days(90), '%Y-%m-%dT%H:%M:%S.000Z') || '","issuedAt":"' || strftime(i, '%Y-%m-%dT%H:%M:%S.000Z') || '","payload":{"c_custkey":' || c_custkey || ',"c_name":"' || case when c_custkey % 10 = 3 then replace(c_name, 'Customer', 'Someone') else c_name end || '","tags":["' || c_mktsegment || '"]}}') body,
        case when c_custkey % 10 = 3 then 'forged' when timestamp '2024-07-01' > i + to_days(90) then 'expired' else 'valid' end state from c""",
    ),
    "webhook_attempts": (
        webhook_attempts,
        """with e as (select event_id n, epoch_us(ts) t from events),
        a as (select n, t, case when n % 3 = 0 then 1 when n % 5 = 0 then 2 when n % 7 = 0 then 3 end h, case when n % 2 = 0 then 4 when n % 11 = 0 then 5 when n % 13 = 0 then 6 end g, n % 4 = 1 again from e)
        select n event_id, case when h is not null or again and g is not null then 'delivered' else 'dead_letter' end status, coalesce(h, case when again then coalesce(g, 6) else 3 end)::bigint attempts,
        case when h is not null or not again then t + [0, 1, 5][coalesce(h, 3)] * 1000000 else t + 86400000000 + [0, 1, 5][coalesce(g, 6) - 3] * 1000000 end ended_us from a""",
    ),
    "webhook_failures": (
        webhook_failures,
        """with e as (select user_id, ts, event_id, event_id % 5 = 0 or event_id % 7 = 0 or event_id % 11 = 0 ok from events), l as (select user_id, max((ts, event_id)) filter (ok) m from e group by 1)
        select user_id, count(*) filter (not ok and (m is null or (ts, event_id) > m)) failures from e join l using (user_id) group by 1""",
    ),
    "latest_devices": (
        latest_devices,
        f"with {SIGNALS_SQL}, r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) i from signals where k is not null) select user_id, count(distinct k) devices, count(distinct k) > 1 switched from r where i <= 5 group by 1",
    ),
}
