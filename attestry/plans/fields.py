"""Queries over single fields and scores: text rules, modality scores, matching,
deliveries, page features and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import numbers, text
from attestry.operators import chains, detectors, fairness, fusion, rules
from attestry.sources.tables import cascade_deleted, deleted, find_first, read, rewritten
from attestry.streaming import folds, outbox


def _names(spark, sf_dir):
    """Customers with Arabic, mixed and Latin texts made from their keys."""
    k = F.col("c_custkey")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    return read(spark, sf_dir, "customer").select(
        "c_custkey",
        pick("  أحمد   محمـد", "إبراهيم آل سعود ", "ليلى", "Nour أحمد", "Jane  Doe", "  ").alias("name"),
        F.translate((k * 7919).cast("string"), "0123456789", "٠1٢3٤5٦7٨9").alias("number"),
        pick("Male", "f", "أنثى", "ذكر", " FEMALE ", "x", "Mr", None).alias("sex"),
        F.concat((k % 28 + 1).cast("string"), pick("/", "-", "."), (k % 12 + 1).cast("string"), F.lit("/"), F.when(k % 2 == 0, (1950 + k % 60).cast("string")).otherwise(F.lpad((k % 100).cast("string"), 2, "0"))).alias("day_first"),
        F.concat(F.lit("O"), (k % 97).cast("string"), F.lit("I-S"), (k % 13).cast("string"), F.lit("b")).alias("scanned"),
    )


_NAMES = """n as (select c_custkey, ['  أحمد   محمـد', 'إبراهيم آل سعود ', 'ليلى', 'Nour أحمد', 'Jane  Doe', '  '][c_custkey % 6 + 1] as name, translate((c_custkey * 7919)::varchar, '0123456789', '٠1٢3٤5٦7٨9') number,
  ['Male', 'f', 'أنثى', 'ذكر', ' FEMALE ', 'x', 'Mr', null][c_custkey % 8 + 1] sex, (c_custkey % 28 + 1) || ['/', '-', '.'][c_custkey % 3 + 1] || (c_custkey % 12 + 1) || '/' || case when c_custkey % 2 = 0 then (1950 + c_custkey % 60)::varchar else lpad((c_custkey % 100)::varchar, 2, '0') end day_first,
  'O' || (c_custkey % 97) || 'I-S' || (c_custkey % 13) || 'b' scanned from customer)"""


def normalized_names(spark, sf_dir):
    n = _names(spark, sf_dir)
    return n.select("c_custkey", text.normalize_arabic("name").alias("arabic"), text.normalize_latin("name").alias("latin"), text.script("name").alias("script"))


def normalized_fields(spark, sf_dir):
    n = _names(spark, sf_dir)
    return n.select("c_custkey", text.digits_only("number").alias("digits"), text.normalize_gender("sex").alias("sex"), text.normalize_date("day_first").alias("date"), text.clean_numeric_id("scanned").alias("scanned"))


def fuzzy_equal(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    other = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit("x"))).when(F.col("p_partkey") % 3 == 1, F.reverse("p_type")).otherwise(F.upper("p_type"))
    return p.select("p_partkey", text.fuzzy_equal("p_type", other).alias("same"))


def modality_scores(spark, sf_dir):
    """The five modality scores of parts as cases."""
    k = F.col("p_partkey")
    part = lambda m: (k % m / (m - 1.0))
    n = lambda a, m, b=0: (k % m * a + b).cast("double")
    rows = read(spark, sf_dir, "part").select(
        "p_partkey", part(11).alias("face_match"), part(7).alias("liveness"), part(5).alias("face_quality"), part(3).alias("blink"), part(13).alias("head_pose"), part(4).alias("expression"), part(6).alias("landmarks"),
        part(9).alias("voice_similarity"), n(20, 17, 40).alias("pitch_mean"), n(9, 10).alias("pitch_std"), n(4, 12).alias("snr"), n(13, 19, 40).alias("speech_rate"), part(8).alias("pause"), part(12).alias("emotion"),
        part(14).alias("keystroke"), n(0.5, 15).alias("mouse_entropy"), part(16).alias("scroll"), part(18).alias("touch"), part(20).alias("angle"), n(15, 25).alias("duration"),
        part(2).alias("mrz_valid"), part(21).alias("tampering_score"), part(22).alias("cross_field_rate"), part(23).alias("ocr_confidence"), n(1, 7).alias("security_features"), n(1500, 29).alias("document_age"), part(24).alias("font"),
        part(26).alias("attestation"), part(27).alias("integrity"), part(28).alias("reputation"),
    )
    scores = {"face": fusion.face_score(), "confidence": fusion.face_confidence(), "voice": fusion.voice_score(), "behavioral": fusion.behavioral_score(), "document": fusion.document_score(), "device": fusion.device_score()}
    return rows.select("p_partkey", *[F.round(c, 6).alias(n) for n, c in scores.items()])


_P = lambda m: f"(p_partkey % {m} / {m - 1}.0::double)"
_R = lambda x, lo, hi: f"greatest(0.0::double, least(1.0::double, ({x} - {lo}) / {hi - lo}.0::double))"
_MODALITY_SQL = f"""with t as (select p_partkey, {_P(11)} fm, {_P(7)} lv, {_P(5)} q, {_P(3)} bl, {_P(13)} hp, {_P(4)} ex, {_P(6)} lm, {_P(9)} vs, (p_partkey % 17 * 20 + 40)::double pm, (p_partkey % 10 * 9)::double ps, (p_partkey % 12 * 4)::double sn, (p_partkey % 19 * 13 + 40)::double sr, {_P(8)} pa, {_P(12)} em,
  {_P(14)} ks, (p_partkey % 15) / 2.0::double me, {_P(16)} sc, {_P(18)} tc, {_P(20)} an, (p_partkey % 25 * 15)::double du, {_P(2)} mv, {_P(21)} ts, {_P(22)} cf, {_P(23)} oc, (p_partkey % 7)::double sf, (p_partkey % 29 * 1500)::double ag, {_P(24)} fo, {_P(26)} att, {_P(27)} itg, {_P(28)} rep from part)
  select p_partkey, round((fm * 0.45::double + lv * 0.35::double + (bl * 0.5::double + hp * 0.3::double + ex * 0.2::double) * 0.2::double) * case when q >= 0.4 then 1.0::double else q / 0.4::double end, 6) face, round(least(1.0::double, 0.95::double * least(q, lv) + 0.05::double * lm), 6) confidence,
  round(vs * 0.6::double + (case when pm between 85 and 255 then 1.0::double else {_R("pm", 50, 300)} end + 0.3::double + 0.7::double * {_R("ps", 0, 80)} + {_R("sn", 5, 40)} + {_R("sr", 60, 220)} + pa + em) / 6 * 0.4::double, 6) voice,
  round(ks * 0.35::double + {_R("me", 0, 5)} * 0.2::double + sc * 0.15::double + tc * 0.1::double + an * 0.1::double + case when du < 10 then du / 10 * 0.5::double else 0.5::double + 0.5::double * {_R("du", 10, 300)} end * 0.1::double, 6) behavioral,
  round(mv * 0.25::double + ts * 0.25::double + cf * 0.2::double + oc * 0.1::double + {_R("sf", 0, 5)} * 0.1::double + case when ag < 1 then 0.5::double when ag < 3650 then 1.0::double else 1 - 0.5::double * {_R("ag", 3650, 36500)} end * 0.05::double + fo * 0.05::double, 6) document,
  round(att * 0.4::double + itg * 0.35::double + rep * 0.25::double, 6) device from t"""


def presentation_attack(spark, sf_dir):
    """Nine anti-spoof signals to a score, the liveness total and its verdict; tampering."""
    k = F.col("o_orderkey")
    part = lambda m: k % m / (m - 1.0)
    pad = detectors.pad_score({n: part(i + 3) for i, n in enumerate(detectors.PAD_WEIGHTS)})
    total = detectors.liveness_total([(k % 40).cast("double"), (k % 31).cast("double")], pad)
    live = detectors.is_live(total, pad, k % 3 > 0, k % 5 > 0, k % 7 == 0, k % 11 == 0)
    tampering = fusion.tampering(part(6), part(9), part(4), part(15))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(pad, 6).alias("pad"), F.round(total, 6).alias("total"), live.alias("live"), F.round(tampering, 6).alias("tampering"))


_O = lambda m: f"(o_orderkey % {m} / {m - 1}.0::double)"


def age_rules(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.date_sub("o_orderdate", (F.col("o_orderkey") % 140 * 365).cast("int")).alias("birth"), F.date_add("o_orderdate", (F.col("o_orderkey") % 2500).cast("int")).alias("expiry"))
    found = rules.flags(*rules.age_flags("birth", "expiry", F.lit("1998-09-01").cast("date")))
    return rows.select("o_orderkey", F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["code"], f["severity"])), ",").alias("flags"))


def box_overlap(spark, sf_dir):
    k = F.col("p_partkey")
    box = lambda a, b, c, d: F.struct((k % a / 20.0).alias("x"), (k % b / 20.0).alias("y"), ((k % c + 1) / 20.0).alias("w"), ((k % d + 1) / 20.0).alias("h"))
    rows = read(spark, sf_dir, "part").select("p_partkey", box(7, 5, 9, 4).alias("a"), box(6, 8, 5, 7).alias("b"))
    return rows.select("p_partkey", F.round(numbers.iou("a", "b"), 6).alias("iou"), F.round(numbers.centre_distance("a", "b"), 6).alias("apart"))


def age_group_bias(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select((F.floor(F.col("o_custkey") % 90 / 20)).cast("string").alias("value"), F.when(F.col("o_orderstatus") == "F", "approve").otherwise("reject").alias("decision"))
    return fairness.demographic_parity(fairness.group_stats(o), name="age_group_bias").withColumn("value", F.round("value", 6))


def outbox_claim(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, "pending").when(F.col("event_id") % 3 == 1, "failed").otherwise("processed").alias("status"), (F.col("event_id") % 7).alias("attempts"))
    return outbox.claimable(e, 50).select("event_id")


def outbox_lag(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return outbox.lag_seconds(e, e.where("event_id % 3 = 0"))


def webhook_delivery(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_type") == "error", 0.0).otherwise(1.0))
    return folds.batch(e, "user_id", folds.delivery(5))


def scheduled_erasure(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.col("ts").alias("requested_at"))
    return outbox.due(e, F.lit("2024-02-10").cast("timestamp_ntz"), 30, "requested_at").select("event_id")


def table_update(spark, sf_dir):
    """Orders after an update, a deletion and a look-up."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    out = deleted(rewritten(o, {"o_orderstatus": "P"}, {"o_orderpriority": "none"}), {"o_orderstatus": "F"})
    return out.unionByName(find_first(o, {"o_orderkey": 7}).withColumn("o_orderpriority", F.lit("found")))


def cascade(spark, sf_dir):
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    kept, lines = cascade_deleted(o.withColumnRenamed("o_orderkey", "k"), li.withColumnRenamed("l_orderkey", "k"), "k", {"o_orderstatus": "F"})
    a, b = kept.agg(F.count("*").alias("orders")), lines.agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
    return a.crossJoin(b)


def content_hashes(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    said = chains.canonical_json("c_name", "c_custkey", "c_mktsegment")
    return c.select("c_custkey", F.md5(said).alias("canonical"), chains.content_id(said).alias("id"), chains.commitment(F.col("c_mktsegment"), F.col("c_custkey")).alias("commitment"))


QUERIES = {
    "normalized_names": (
        normalized_names,
        f"""with {_NAMES} select c_custkey, nullif(trim(regexp_replace(replace(translate(name, 'آأإٱى', 'ااااي'), 'ـ', ''), '\\s+', ' ', 'g')), '') arabic, nullif(trim(regexp_replace(name, '\\s+', ' ', 'g')), '') latin,
        case when regexp_matches(name, '[؀-ۿ]') and regexp_matches(name, '[A-Za-z]') then 'mixed' when regexp_matches(name, '[؀-ۿ]') then 'arabic' when regexp_matches(name, '[A-Za-z]') then 'latin' else 'none' end script from n""",
    ),
    "normalized_fields": (
        normalized_fields,
        f"""with {_NAMES}, d as (select *, string_split(translate(day_first, '-.', '//'), '/') p from n)
        select c_custkey, (c_custkey * 7919)::varchar digits, case c_custkey % 8 when 0 then 'Male' when 1 then 'Female' when 2 then 'Female' when 3 then 'Male' when 4 then 'Female' when 6 then 'Male' end sex,
        case when len(p[3]) = 2 then case when p[3]::int > 30 then '19' else '20' end else '' end || p[3] || '-' || lpad(p[2], 2, '0') || '-' || lpad(p[1], 2, '0') as date, '0' || (c_custkey % 97) || '15' || (c_custkey % 13) || '8' scanned from d""",
    ),
    "fuzzy_equal": (
        fuzzy_equal,
        """with t as (select p_partkey, lower(p_type) a, lower(case p_partkey % 3 when 0 then p_type || 'x' when 1 then reverse(p_type) else upper(p_type) end) b from part), c as (select p_partkey, regexp_replace(a, '[^a-z0-9]', '', 'g') a, regexp_replace(b, '[^a-z0-9]', '', 'g') b from t)
        select p_partkey, a = b same from c""",
    ),
    "modality_scores": (modality_scores, _MODALITY_SQL),
    "presentation_attack": (
        presentation_attack,
        f"""with t as (select o_orderkey k, least(1.0::double, {_O(3)} * 0.18::double + {_O(4)} * 0.15::double + {_O(5)} * 0.15::double + {_O(6)} * 0.10::double + {_O(7)} * 0.15::double + {_O(8)} * 0.10::double + {_O(9)} * 0.07::double + {_O(10)} * 0.05::double + {_O(11)} * 0.05::double) pad,
        least(1.0::double, 0.2::double * {_O(6)} + 0.3::double * {_O(9)} + 0.25::double * {_O(4)} + 0.35::double * {_O(15)}) tampering from orders), u as (select *, greatest(0.0::double, least(100.0::double, floor(k % 40 + k % 31 + (pad - 0.5::double) * 20 + 0.5))) total from t)
        select k o_orderkey, round(pad, 6) pad, total, (total >= 60 and k % 3 > 0 and k % 5 > 0 and k % 7 > 0 and k % 11 > 0) or (pad >= 0.65 and k % 3 > 0 and k % 5 > 0) live, round(tampering, 6) tampering from u""",
    ),
    "age_rules": (
        age_rules,
        """with t as (select o_orderkey, (date '1998-09-01' - (o_orderdate::date - (o_orderkey % 140 * 365)::int)) / 365.25::double age, (o_orderdate::date + (o_orderkey % 2500)::int) - date '1998-09-01' ends from orders)
        select o_orderkey, concat_ws(',', case when age < 18 then 'UNDERAGE:critical' end, case when age > 120 then 'AGE_IMPLAUSIBLE:warning' end, case when ends < 0 then 'DOCUMENT_EXPIRED:critical' when ends < 30 then 'EXPIRING_SOON:info' end) flags from t""",
    ),
    "box_overlap": (
        box_overlap,
        """with t as (select p_partkey, p_partkey % 7 / 20.0::double ax, p_partkey % 5 / 20.0::double ay, (p_partkey % 9 + 1) / 20.0::double aw, (p_partkey % 4 + 1) / 20.0::double ah, p_partkey % 6 / 20.0::double bx, p_partkey % 8 / 20.0::double bh0, (p_partkey % 5 + 1) / 20.0::double bw, (p_partkey % 7 + 1) / 20.0::double bh from part),
        i as (select *, greatest(0.0::double, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0.0::double, least(ay + ah, bh0 + bh) - greatest(ay, bh0)) inter from t)
        select p_partkey, round(coalesce(inter / nullif(aw * ah + bw * bh - inter, 0), 0), 6) iou, round(sqrt(pow(ax + aw / 2 - bx - bw / 2, 2) + pow(ay + ah / 2 - bh0 - bh / 2, 2)), 6) apart from i""",
    ),
    "age_group_bias": (age_group_bias, "with p as (select o_custkey % 90 // 20 g, avg((o_orderstatus = 'F')::int) p from orders group by 1), m as (select coalesce(min(p) / nullif(max(p), 0), 1) v from p) select 'age_group_bias' metric, round(v, 6) as value, case when v >= 0.8 then 'pass' when v >= 0.7 then 'review' else 'fail' end status from m"),
    "outbox_claim": (outbox_claim, "select event_id from events where event_id % 3 < 2 and event_id % 7 < 5 order by ts, event_id limit 50"),
    "outbox_lag": (outbox_lag, "select (epoch_us(max(ts)) - epoch_us(max(ts) filter (event_id % 3 = 0))) / 1000000.0::double lag_s from events"),
    "webhook_delivery": (webhook_delivery, "select user_id, event_id, n, case when event_type <> 'error' then 'delivered' when n >= 5 then 'dead_letter' else 'retry' end as level from (select *, row_number() over (partition by user_id order by ts, event_id) n from events)"),
    "scheduled_erasure": (scheduled_erasure, "select event_id from events where event_type = 'error' and timestamp '2024-02-10' >= ts + interval 30 days"),
    "table_update": (table_update, "select o_orderkey, o_orderstatus, case when o_orderstatus = 'P' then 'none' else o_orderpriority end o_orderpriority from orders where o_orderstatus <> 'F' union all select o_orderkey, o_orderstatus, 'found' from orders where o_orderkey = 7"),
    "cascade": (cascade, "select (select count(*) from orders where o_orderstatus <> 'F') orders, count(*) as lines, sum(l_quantity::bigint)::bigint quantity from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')"),
    "content_hashes": (
        content_hashes,
        """with t as (select c_custkey, c_mktsegment, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}' j from customer) select c_custkey, md5(j) canonical, 'att_' || substr(sha256(j), 1, 32) as id, sha256(c_mktsegment || ':' || c_custkey) "commitment" from t""",
    ),
}
