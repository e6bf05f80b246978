"""The risk engine over orders as cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import risk, rules
from attestry.sources.tables import read


def _cases(spark, sf_dir):
    k = F.col("o_orderkey")
    part = lambda m: k % m / (m - 1.0)
    when = lambda m, s: F.when(k % m > 0, s)
    document = F.struct((0.5 + part(11) / 2).alias("confidence"), (0.4 + part(7) * 0.6).alias("ocr_confidence"), F.when(k % 13 == 0, 0.5).otherwise(part(9) * 0.2).alias("tampering"), (k % 17 > 0).alias("mrz_valid"),
                        F.create_map(F.lit("hologram"), k % 3 > 0, F.lit("watermark"), k % 5 > 0, F.lit("microprint"), k % 9 > 0, F.lit("uv"), k % 15 > 0).alias("features"))
    face = F.struct((k % 23 > 0).alias("detected"), (k % 46 == 0).alias("has_embedding"), (k % 19 > 0).alias("is_match"), (0.6 + part(8) * 0.4).alias("similarity"), part(6).alias("quality"))
    live = F.struct((k % 14 > 0).alias("is_live"), F.when(k % 14 > 0, part(10) * 0.3).otherwise(part(4)).alias("pad_score"), part(12).alias("texture"), F.when(k % 29 == 0, 0.1).alias("frequency"), part(16).alias("depth"))
    device = F.struct(part(5).alias("trust_score"))
    cross = F.struct((0.5 + part(6) / 2).alias("consistency"), F.array_compact(F.array(F.when(k % 21 == 0, "CROSS_FIELD_NAME_MISMATCH"), F.when(k % 33 == 0, "CROSS_FIELD_DOB_MISMATCH"), F.when(k % 10 == 3, "CROSS_FIELD_GENDER_MISMATCH"))).alias("flags"))
    ai = F.struct(F.when(k % 8 == 0, part(3)).alias("confidence"), F.when(k % 18 > 0, F.array(F.lit("a"), F.when(k % 2 == 0, "b").otherwise("a"), F.when(k % 3 == 0, "c").otherwise("a"))).alias("decisions"))
    return read(spark, sf_dir, "orders").select("o_orderkey", document.alias("document"), face.alias("face"), when(31, live).alias("liveness"), when(6, device).alias("device"), when(20, cross).alias("cross_field"), when(22, ai).alias("ai_consensus"))


def risk_engine(spark, sf_dir):
    r = _cases(spark, sf_dir).select("o_orderkey", risk.evaluate().alias("r"))
    return r.select("o_orderkey", F.round("r.score", 4).alias("score"), "r.decision", F.array_join("r.codes", ",").alias("codes"), F.size("r.factors").cast("long").alias("factors"))


def reason_codes(spark, sf_dir):
    """How often each code is given, with its severity."""
    r = _cases(spark, sf_dir).select(F.explode(risk.evaluate()["codes"]).alias("code"))
    return r.groupBy("code").agg(F.count("*").alias("n")).withColumn("severity", risk.severity(F.col("code")))


def confidence_breakdown(spark, sf_dir):
    k = F.col("o_orderkey")
    item = lambda c, m, other="fail": F.struct(F.lit(c).alias("check"), F.when(k % m > 0, "pass").otherwise(other).alias("result"))
    e = F.array(item("MRZ_digits", 7), item("cross_field_name", 11), item("cross_field_birth", 4), item("document_structure", 5), item("chip_read", 3, "not_performed"), item("issuer_registry", 2))
    f = F.array(F.struct(F.lit("ocr").alias("source"), (k % 10 / 10).alias("confidence")), F.struct(F.when(k % 2 == 0, "ocr").otherwise("mrz").alias("source"), F.when(k % 3 > 0, 0.9).alias("confidence")))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", e.alias("e"), f.alias("f"))
    b = rows.select("o_orderkey", rules.confidence_breakdown("e", "f", k % 9 / 9, k % 8 / 8).alias("b"))
    return b.select("o_orderkey", *[F.round(f"b.{c}", 6).alias(c) for c in ("ocr", "structural", "cross_field", "authenticity", "liveness", "face_match")])


_P = lambda m: f"(k % {m} / {m - 1}.0::double)"
_CASES = f"""c as (select o_orderkey k, 0.5::double + {_P(11)} / 2 conf, 0.4::double + {_P(7)} * 0.6::double ocr, case when k % 13 = 0 then 0.5::double else {_P(9)} * 0.2::double end tam, k % 17 > 0 mrz, k % 3 > 0 holo, k % 5 > 0 water, k % 9 > 0 micro, k % 15 > 0 uv,
  k % 23 = 0 and k % 46 > 0 noface, k % 19 > 0 mat, 0.6::double + {_P(8)} * 0.4::double sim, {_P(6)} q, k % 31 > 0 hl, k % 31 > 0 and k % 14 > 0 lv, case when k % 31 = 0 then 1.0::double when k % 14 > 0 then {_P(10)} * 0.3::double else {_P(4)} end pad,
  {_P(12)} tex, {_P(16)} dep, k % 6 > 0 hd, {_P(5)} trust, k % 20 > 0 hc, case when k % 20 > 0 then 0.5::double + {_P(6)} / 2 else 0.5::double end cf, k % 22 > 0 ha, k % 22 > 0 and k % 18 > 0 said,
  case when k % 22 = 0 then 0.5::double when k % 8 = 0 then {_P(3)} when k % 18 = 0 then 0.5::double when k % 6 = 0 then 1 / 3.0::double when k % 2 = 0 or k % 3 = 0 then 2 / 3.0::double else 1.0::double end ai from (select o_orderkey, o_orderkey k from orders)),
  s as (select *, (holo::int + water::int + micro::int + uv::int) / 4.0::double sec, case when tam > 0.3 then 0 else conf * (1 - tam) * case when mrz then 1.0::double else 0.5::double end end ds,
  case when noface then 0 when mat then least(1.0::double, sim * 1.2::double) else sim * 0.3::double end * case when q < 0.4 then 0.7::double else 1.0::double end fs, case when lv then 1 - pad else 0 end ls from c),
  t as (select *, (ds * 0.18::double + fs * 0.20::double + ls * 0.15::double + case when hd then trust * 0.05::double else 0 end + cf * 0.10::double + sec * 0.08::double + case when mat then least(1.0::double, sim) else 0 end * 0.10::double + (1 - pad) * 0.08::double + ai * 0.04::double + ocr * 0.02::double)
  / (0.95::double + case when hd then 0.05::double else 0 end) score, list_filter([case when not mrz then 'DOC_MRZ_INVALID' end, case when tam > 0.3 then 'DOC_TAMPERED' when conf > 0.7 then 'DOC_PASS' when conf < 0.5 then 'DOC_LOW_CONFIDENCE' end, case when sec >= 0.7 then 'DOC_GENUINE_SECURITY' end,
  case when not holo then 'DOC_HOLOGRAM_MISSING' end, case when not water then 'DOC_WATERMARK_MISSING' end, case when not micro then 'DOC_MICROPRINT_MISSING' end, case when not uv then 'DOC_UV_FEATURE_MISSING' end, case when sec <= 0.25 then 'DOC_SECURITY_FEATURE_MISSING' end,
  case when noface then 'FACE_NO_FACE' when mat then 'FACE_MATCH' else 'FACE_MISMATCH' end, case when q < 0.4 then 'FACE_LOW_QUALITY' when q >= 0.8 then 'FACE_HIGH_QUALITY' end, case when lv then 'LIVE_CONFIRMED' when hl then 'LIVE_FAILED' end, case when hl and not lv and pad > 0.5 then 'LIVE_PAD_SCORE_HIGH' end,
  case when hl and tex < 0.3 then 'LIVE_TEXTURE_ANOMALY' end, case when hl and k % 29 = 0 then 'LIVE_MOIRE_DETECTED' end, case when hl and dep < 0.3 then 'LIVE_DEPTH_FLAT' end, case when hd and trust >= 0.7 then 'DEVICE_TRUSTED' when hd and trust < 0.5 then 'DEVICE_LOW_TRUST' end,
  case when hc and cf >= 0.9 then 'CROSS_FIELD_PASS' end, case when hc and k % 21 = 0 then 'CROSS_FIELD_NAME_MISMATCH' end, case when hc and k % 33 = 0 then 'CROSS_FIELD_DOB_MISMATCH' end, case when hc and k % 10 = 3 then 'CROSS_FIELD_GENDER_MISMATCH' end,
  case when said and ai >= 0.9 then 'AI_CONSENSUS_AGREE' when said and ai >= 0.6 then 'AI_CONSENSUS_SPLIT' when said then 'AI_CONSENSUS_DISAGREE' when ha then 'AI_CONSENSUS_INSUFFICIENT' end, case when ocr >= 0.85 then 'OCR_SUCCESS' when ocr < 0.5 then 'OCR_GARBLED' when ocr < 0.7 then 'OCR_LOW_CONFIDENCE' end], lambda x: x is not null) codes from s),
  u as (select k, floor(score * 10000.0::double + 0.5) / 10000.0::double score, codes, 9 + hd::int n, case when list_has_any(codes, ['DOC_TAMPERED', 'FACE_MISMATCH', 'FACE_NO_FACE', 'LIVE_FAILED', 'LIVE_PAD_SCORE_HIGH', 'LIVE_MOIRE_DETECTED', 'OCR_GARBLED', 'CROSS_FIELD_DOB_MISMATCH']) then 'reject' when score >= 0.8 then 'approve' when score >= 0.6 then 'review' else 'reject' end decision from t),
  v as (select *, list_append(codes, case decision when 'approve' then 'APPROVED' when 'review' then 'REVIEW_NEEDED' else 'REJECTED' end) all_codes from u)"""
QUERIES = {
    "risk_engine": (risk_engine, f"with {_CASES} select k o_orderkey, round(score, 4) score, decision, array_to_string(all_codes, ',') codes, n::bigint factors from v"),
    "confidence_breakdown": (
        confidence_breakdown,
        """select k o_orderkey, round(case when k % 2 = 0 then (case when k % 10 = 0 then 0.5::double else k % 10 / 10.0::double end + case when k % 3 > 0 then 0.9::double else 0.5::double end) / 2 else case when k % 10 = 0 then 0.5::double else k % 10 / 10.0::double end end, 6) ocr,
        round(((k % 7 > 0)::int + (k % 11 > 0)::int + (k % 4 > 0)::int + (k % 5 > 0)::int) / 4.0::double, 6) structural, ((k % 11 > 0)::int + (k % 4 > 0)::int) / 2.0::double cross_field, (k % 3 > 0)::int + (k % 2 > 0)::int / 2.0::double authenticity,
        round(k % 9 / 9.0::double, 6) liveness, round(k % 8 / 8.0::double, 6) face_match from (select o_orderkey k from orders)""",
    ),
    "reason_codes": (
        reason_codes,
        f"""with {_CASES}, w as (select unnest(all_codes) code from v) select code, count(*) n, case when code in ('DOC_PASS', 'DOC_GENUINE_SECURITY', 'FACE_MATCH', 'FACE_HIGH_QUALITY', 'LIVE_CONFIRMED', 'OCR_SUCCESS', 'CROSS_FIELD_PASS', 'AI_CONSENSUS_AGREE', 'DEVICE_TRUSTED', 'APPROVED') then 'positive'
        when code in ('DOC_TAMPERED', 'FACE_MISMATCH', 'FACE_NO_FACE', 'LIVE_FAILED', 'LIVE_PAD_SCORE_HIGH', 'LIVE_MOIRE_DETECTED', 'OCR_GARBLED', 'CROSS_FIELD_DOB_MISMATCH') then 'critical' when code in ('DOC_MRZ_INVALID', 'DOC_SECURITY_FEATURE_MISSING', 'DOC_UV_FEATURE_MISSING', 'LIVE_TEXTURE_ANOMALY', 'LIVE_DEPTH_FLAT', 'CROSS_FIELD_NAME_MISMATCH', 'AI_CONSENSUS_DISAGREE', 'REJECTED') then 'negative' else 'warning' end severity from w group by 1""",
    ),
}
