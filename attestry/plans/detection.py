"""Queries on detectors, document reading and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import checksums
from attestry.operators import detectors, documents, fusion, quotas
from attestry.plans.common import SIGNALS_SQL, signals
from attestry.sources import models
from attestry.sources.tables import read


def _arrays(spark, sf_dir):
    e = signals(spark, sf_dir)
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("e"))
    return rows.select("user_id", F.transform("e", lambda x: x["value"]).alias("v"))


def screen_replay(spark, sf_dir):
    out = _arrays(spark, sf_dir).select("user_id", detectors.screen_replay("v").alias("d"))
    return out.select("user_id", F.round("d.score", 4).alias("score"))


def silicone(spark, sf_dir):
    out = _arrays(spark, sf_dir).select("user_id", detectors.silicone("v").alias("d"))
    return out.select("user_id", F.round("d.score", 4).alias("score"))


def mask_depth(spark, sf_dir):
    out = _arrays(spark, sf_dir).select("user_id", detectors.mask_3d("v").alias("d"))
    return out.select("user_id", F.round("d.score", 4).alias("score"))


def attack_battery(spark, sf_dir):
    v = _arrays(spark, sf_dir)
    rows = v.select("user_id", F.col("v").alias("frequency"), F.col("v").alias("histogram"), F.col("v").alias("depth"), F.col("v").alias("spectrum"), F.col("v").alias("texture"), F.col("v").alias("fingerprint"), F.transform("v", lambda x: x - 40).alias("gradient"), F.lit(30.0).alias("epsilon"), F.lit(2.0).alias("l2"), F.lit(0.1).alias("linf"), F.lit(4.0).alias("entropy"), F.lit(9000).alias("size_bytes"))
    found = rows.withColumn("d", detectors.battery())
    out = found.select("user_id", fusion.ensemble("d").alias("v"), F.size("d").alias("n"))
    return out.select("user_id", F.round("v.score", 4).alias("score"), "v.band", F.array_join("v.fingerprint", ",").alias("kinds"), F.col("n").cast("long").alias("n"))


def perturbation(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    d = detectors.perturbation(F.col("p_size") / 2.0, F.col("p_size") / 100.0, F.col("p_partkey") % 7)
    return p.select("p_partkey", F.round(d["score"], 4).alias("score"), F.round(d["confidence"], 6).alias("confidence"))


def repaired_ids(spark, sf_dir):
    """Nine-digit keys as they are or with a digit left out or put in, repaired by checksum."""
    c = read(spark, sf_dir, "customer")
    base = F.lpad((F.col("c_custkey") * 7919 % 999999937).cast("string"), 9, "0")
    raw = F.when(F.col("c_custkey") % 3 == 1, F.concat(F.substring(base, 1, 4), F.lit("7"), F.substring(base, 5, 5))).when(F.col("c_custkey") % 3 == 2, F.concat(F.substring(base, 1, 3), F.substring(base, 5, 5))).otherwise(base)
    rows = c.select("c_custkey", raw.alias("raw"))
    digits = lambda s: F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.ascii(s.substr(i, F.lit(1))) - 48)
    luhn = lambda s: F.aggregate(F.transform(digits(s), lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)), F.lit(0), lambda a, b: a + b) % 10 == 0
    out = documents.repaired_id(rows, "c_custkey", "raw", 9, luhn)
    return out.select("c_custkey", "repaired", "repaired_ok")


def explanation(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    found = documents.consensus_findings(k % 5, k % 2) + [("OCR Correction Applied", k % 4 == 1)] + documents.id_findings(k % 7 > 0, k % 3 == 0)
    found += documents.cross_field_findings(k % 13 == 0, k % 11 / 10.0, k % 9 / 10.0) + [("Image Blur", k % 6 == 0), ("Glare Detected", k % 10 == 3), ("Lighting", k % 8 == 5), ("Good Image Quality", k % 6 == 1)]
    found += [("Liveness Challenge Met", k % 3 > 0), ("Liveness Challenge Failed", k % 3 == 0), ("Anti-Spoofing Passed", k % 21 >= 15), ("Document Tampering Detected", k % 17 == 0), ("No Tampering Detected", k % 17 > 0)]
    e = documents.explained(F.when(k % 19 > 0, k % 100 / 100.0), (k % 101).cast("double"), (k % 97).cast("double"), found)
    return o.select("o_orderkey", e.alias("e")).select("o_orderkey", "e.base", "e.score", F.size("e.factors").cast("long").alias("n"))


def liveness_fusion(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    part = lambda m: F.col("p_partkey") % m / (m - 1.0)
    s = detectors.liveness_signals({"texture": part(5), "frequency": part(7), "depth": F.when(F.col("p_partkey") % 2 == 0, part(3)), "motion": part(11), "deepfake": part(4)})
    return p.select("p_partkey", s.alias("s")).select("p_partkey", "s.pad", "s.live")


def country_count(spark, sf_dir):
    """Customers, dealt to all countries with an ID rule, by how their IDs are cleaned."""
    table = [F.struct(F.lit(r.clean if r.clean in ("digits", "alnum", "spaces") else "other").alias("clean"), F.lit(r.checksum != "true").alias("has_checksum")) for r in checksums.RULES.values()]
    rule = F.element_at(F.array(*table), (F.col("c_custkey") % len(table) + 1).cast("int"))
    return read(spark, sf_dir, "customer").select(rule.alias("r")).groupBy("r.clean").agg(F.count("*").alias("n"), F.count_if("r.has_checksum").alias("checked"))


def quota_usage(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rank = F.element_at(F.array(*[F.lit(f"P{i}") for i in range(5)]), (F.col("event_id") % 5 + 1).cast("int"))
    used = quotas.usage(e, 300, "ts", "event_id", "day")
    return used.withColumn("verdict", quotas.verdict(rank, F.col("level"))).groupBy("level", "verdict").agg(F.count("*").alias("n"))


def model_scores(spark, sf_dir):
    model = models.Linear((0.5, -0.25, 0.125), -0.3)
    p = read(spark, sf_dir, "part")
    features = F.array((F.col("p_size") / 10).cast("double"), (F.col("p_partkey") % 7).cast("double"))
    return p.select("p_partkey", F.round(model.score(features), 6).alias("p"))


_V = f"with {SIGNALS_SQL}, a as (select user_id, list(value order by event_id) v, avg(value) m, stddev_pop(value) s, count(*) n from signals group by 1)"
QUERIES = {
    "screen_replay": (
        screen_replay,
        f"""{_V}, b as (select *, len(list_filter(v, lambda x: x - m > 3 * s)) / n::double spikes, coalesce(list_avg(v[1:(n // 2) // 4]), 0) low, coalesce(list_avg(v[n // 2 + 1:n]), 0) high from a), c as (select *, coalesce(high / nullif(low, 0), 0) r from b)
        select user_id, round(case when spikes > 0.05 then 0.4::double when spikes > 0.02 then 0.2::double else 0 end + case when r > 0.5 then 0.35::double when r > 0.2 then 0.15::double else 0 end, 4) score from c""",
    ),
    "silicone_finger": (
        silicone,
        f"""{_V}, b as (select *, s / m u, len(list_filter(v, lambda x: x < m - s)) / n::double dips, len(list_filter(v, lambda x: x > m + 3 * s)) far from a)
        select user_id, round(least(1, case when u < 0.05 then 0.4::double when u < 0.1 then 0.2::double else 0 end + case when dips < 0.02 then 0.35::double when dips < 0.05 then 0.15::double else 0 end + case when far >= 3 then 0.25::double else 0 end), 4) score from b""",
    ),
    "mask_depth": (
        mask_depth,
        f"""{_V}, b as (select *, s / m u, len(list_filter(range(2, n + 1), lambda i: abs(v[i] - v[i - 1]) > m * 2)) / n::double d from a)
        select user_id, round(case when u < 0.05 then 0.4::double when u < 0.1 then 0.2::double else 0 end + case when d > 0.1 then 0.3::double else 0 end, 4) score from b""",
    ),
    "attack_battery": (attack_battery, None),
    "perturbation": (
        perturbation,
        """with t as (select p_partkey, p_size / 2.0::double a, p_size / 100.0::double b, p_partkey % 7 c from part), s as (select *, case when a > 1 and a < 20 then 0.3::double else 0 end + case when b > 0.01 and b < 0.5 then 0.3::double else 0 end + case when c > 5 then 0.25::double when c > 3 then 0.1::double else 0 end s from t)
        select p_partkey, round(s, 4) score, round(least(1, 0.3::double + 0.5::double * abs(s - 0.5::double) + 0.2::double * (0.1::double + case when a > 0 then 0.3::double else 0 end + case when b > 0 then 0.3::double else 0 end + case when c > 0 then 0.3::double else 0 end)), 6) confidence from s""",
    ),
    "repaired_ids": (repaired_ids, None),
    "explanation": (
        explanation,
        """with t as (select o_orderkey k, list_filter([case when k % 5 >= 3 then 0.3::double when k % 5 >= 2 then 0.15::double else -0.2::double end, case when k % 2 > 0 then 0.05::double end, case when k % 4 = 1 then 0.05::double end, case when k % 3 = 0 then 0.1::double when k % 7 = 0 then -0.15::double else -0.1::double end,
        case when k % 13 = 0 then -0.2::double when k % 11 >= 8 then 0.1::double when k % 11 > 0 and k % 11 < 5 then -0.1::double end, case when k % 9 > 3 then -0.15::double end, case when k % 6 = 0 then -0.1::double end, case when k % 10 = 3 then -0.05::double end, case when k % 8 = 5 then -0.05::double end, case when k % 6 = 1 then 0.05::double end,
        case when k % 3 > 0 then 0.1::double else -0.15::double end, case when k % 21 >= 15 then 0.05::double end, case when k % 17 = 0 then -0.3::double else 0.05::double end], lambda x: x is not null) c, case when k % 19 > 0 then k % 100 / 100.0::double else 0 end * 100 * 0.3::double + k % 101 * 0.4::double + k % 97 * 0.3::double b from orders)
        select k o_orderkey, floor(b + 0.5::double)::double base, greatest(0, least(100, floor(b + list_reduce(c, lambda x, y: x + y) * 20 + 0.5::double)))::double score, len(c)::bigint n from t""",
    ),
    "liveness_fusion": (
        liveness_fusion,
        """with t as (select p_partkey k, p_partkey % 5 / 4.0::double a, p_partkey % 7 / 6.0::double b, case when p_partkey % 2 = 0 then p_partkey % 3 / 2.0::double end c, p_partkey % 11 / 10.0::double d, p_partkey % 4 / 3.0::double e from part),
        s as (select k, ((1 - a) * 0.2::double + (1 - b) * 0.2::double + coalesce((1 - c) * 0.15::double, 0) + (1 - d) * 0.25::double + (1 - e) * 0.2::double) / (0.2::double + 0.2::double + case when c is null then 0.0::double else 0.15::double end + 0.25::double + 0.2::double) p from t)
        select k p_partkey, floor(p * 10000.0::double + 0.5) / 10000.0::double pad, p < 0.5 live from s""",
    ),
    "id_rules": (country_count, None),
    "quota_usage": (
        quota_usage,
        """with u as (select 'P' || (event_id % 5) p, 100.0::double * row_number() over (partition by date_trunc('day', ts) order by ts, event_id) / 300 n from events),
        b as (select p, case when n >= 100 then 'exhausted' when n >= 95 then 'emergency' when n >= 90 then 'restrict' when n >= 80 then 'warning' when n >= 70 then 'monitoring' else 'ok' end as level from u)
        select level, case level when 'restrict' then case p when 'P4' then 'suppress' when 'P3' then 'defer' else 'send' end when 'emergency' then case when p in ('P0', 'P1') then 'send' else 'defer' end when 'exhausted' then case p when 'P0' then 'send' else 'defer' end else 'send' end verdict, count(*) n from b group by 1, 2""",
    ),
    "model_scores": (model_scores, "select p_partkey, round(1 / (1 + exp(-(p_size / 10.0::double * 0.5::double - (p_partkey % 7) * 0.25::double - 0.3::double))), 6) p from part"),
}
