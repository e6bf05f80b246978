"""Risk engine: evidence of one case to signals, reason codes, score, decision.

Reads structs, any of which may be null: ``document`` (confidence,
ocr_confidence, tampering, mrz_valid, features: map of security features),
``face`` (detected, has_embedding, is_match, similarity, quality), ``liveness``
(is_live, pad_score, texture, frequency, depth), ``device`` (trust_score),
``cross_field`` (consistency, flags) and ``ai_consensus`` (confidence, decisions of
providers).  Everything is column arithmetic, one row a case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions.numbers import bound, clamp, half_up
from attestry.operators.rules import RISK_WEIGHTS

#: Reason codes by severity.
REASON_CODES = {
    "positive": ("DOC_PASS", "DOC_GENUINE_SECURITY", "FACE_MATCH", "FACE_HIGH_QUALITY", "LIVE_CONFIRMED", "OCR_SUCCESS", "CROSS_FIELD_PASS", "AI_CONSENSUS_AGREE", "DEVICE_TRUSTED", "APPROVED", "SERVICE_HEALTHY"),
    "warning": (
        "DOC_LOW_CONFIDENCE", "DOC_MRZ_MISSING", "DOC_HOLOGRAM_MISSING", "DOC_WATERMARK_MISSING", "DOC_MICROPRINT_MISSING", "DOC_TYPE_UNSUPPORTED", "FACE_LOW_QUALITY", "FACE_POSE_EXTREME", "FACE_EYE_CLOSED", "FACE_TOO_SMALL", "LIVE_SINGLE_FRAME",
        "OCR_LOW_CONFIDENCE", "OCR_PARTIAL", "CROSS_FIELD_GENDER_MISMATCH", "CROSS_FIELD_NATIONALITY_MISMATCH", "AI_CONSENSUS_SPLIT", "AI_CONSENSUS_INSUFFICIENT", "AI_PROVIDER_ERROR", "DEVICE_VPN", "DEVICE_LOW_TRUST", "REVIEW_NEEDED", "SERVICE_DEGRADED", "RATE_LIMITED",
    ),
    "negative": (
        "DOC_EXPIRED", "DOC_MRZ_INVALID", "DOC_SECURITY_FEATURE_MISSING", "DOC_UV_FEATURE_MISSING", "FACE_MULTIPLE_FACES", "FACE_OCCLUDED", "LIVE_LOW_SCORE", "LIVE_TEXTURE_ANOMALY", "LIVE_DEPTH_FLAT", "OCR_FIELD_MISSING", "CROSS_FIELD_NAME_MISMATCH",
        "AI_CONSENSUS_DISAGREE", "DEVICE_ROOTED", "REJECTED", "SERVICE_TIMEOUT",
    ),
    "critical": (
        "DOC_FORGERY", "DOC_TAMPERED", "DOC_MRZ_CHECKSUM_FAIL", "FACE_MISMATCH", "FACE_NO_FACE", "LIVE_FAILED", "LIVE_NO_FRAMES", "LIVE_PAD_SCORE_HIGH", "LIVE_MOIRE_DETECTED", "LIVE_CHALLENGE_FAILED", "OCR_GARBLED", "CROSS_FIELD_DOB_MISMATCH",
        "DEVICE_EMULATOR", "INTERNAL_ERROR",
    ),
}


#: What each code says.
DESCRIPTIONS = {
    "DOC_PASS": "Document authenticity verified",
    "DOC_FORGERY": "Document forgery detected",
    "DOC_EXPIRED": "Document expired",
    "DOC_TAMPERED": "Document image tampered",
    "DOC_MRZ_INVALID": "MRZ check digit invalid",
    "DOC_LOW_CONFIDENCE": "Document OCR confidence low",
    "DOC_MRZ_MISSING": "MRZ field missing",
    "DOC_MRZ_CHECKSUM_FAIL": "MRZ checksum failed",
    "DOC_SECURITY_FEATURE_MISSING": "Required security feature missing",
    "DOC_HOLOGRAM_MISSING": "Hologram not detected",
    "DOC_WATERMARK_MISSING": "Watermark not detected",
    "DOC_MICROPRINT_MISSING": "Microprint not detected",
    "DOC_UV_FEATURE_MISSING": "UV security feature missing",
    "DOC_GENUINE_SECURITY": "Security features match expected pattern",
    "DOC_TYPE_UNSUPPORTED": "Document type not supported",
    "FACE_MATCH": "Face matches document photo",
    "FACE_MISMATCH": "Face does not match document",
    "FACE_NO_FACE": "No face detected",
    "FACE_LOW_QUALITY": "Face image quality too low",
    "FACE_MULTIPLE_FACES": "Multiple faces detected",
    "FACE_POSE_EXTREME": "Face pose extreme (yaw/pitch/roll)",
    "FACE_EYE_CLOSED": "Eye closed — biometric quality insufficient",
    "FACE_OCCLUDED": "Face occluded (mask, hair, hand)",
    "FACE_TOO_SMALL": "Face too small in image",
    "FACE_HIGH_QUALITY": "Face image quality is high",
    "LIVE_CONFIRMED": "Liveness confirmed",
    "LIVE_FAILED": "Liveness check failed — possible spoof",
    "LIVE_LOW_SCORE": "Liveness score below threshold",
    "LIVE_NO_FRAMES": "No liveness frames provided",
    "LIVE_SINGLE_FRAME": "Only one frame provided — passive motion unavailable",
    "LIVE_PAD_SCORE_HIGH": "PAD score above 0.5 — likely attack",
    "LIVE_TEXTURE_ANOMALY": "Texture anomaly detected",
    "LIVE_MOIRE_DETECTED": "Screen moiré pattern detected",
    "LIVE_DEPTH_FLAT": "Depth map appears flat (likely print attack)",
    "LIVE_CHALLENGE_FAILED": "Liveness challenge failed",
    "OCR_SUCCESS": "OCR extraction successful",
    "OCR_LOW_CONFIDENCE": "OCR confidence below 0.7",
    "OCR_FIELD_MISSING": "Required field missing from OCR",
    "OCR_GARBLED": "OCR output garbled — unreadable",
    "OCR_PARTIAL": "OCR partial — some fields missing",
    "CROSS_FIELD_PASS": "All cross-field checks passed",
    "CROSS_FIELD_NAME_MISMATCH": "Cross-field name mismatch",
    "CROSS_FIELD_DOB_MISMATCH": "Date of birth mismatch",
    "CROSS_FIELD_GENDER_MISMATCH": "Gender mismatch",
    "CROSS_FIELD_NATIONALITY_MISMATCH": "Nationality mismatch",
    "AI_CONSENSUS_AGREE": "All AI providers agree",
    "AI_CONSENSUS_DISAGREE": "AI providers disagree",
    "AI_CONSENSUS_SPLIT": "AI provider consensus split",
    "AI_CONSENSUS_INSUFFICIENT": "Insufficient AI providers (need ≥2)",
    "AI_PROVIDER_ERROR": "AI provider returned error",
    "DEVICE_TRUSTED": "Device signals trusted",
    "DEVICE_EMULATOR": "Emulator detected",
    "DEVICE_ROOTED": "Rooted/jailbroken device",
    "DEVICE_VPN": "VPN/proxy detected",
    "DEVICE_LOW_TRUST": "Device trust score below 0.5",
    "APPROVED": "Verification approved",
    "REVIEW_NEEDED": "Manual review required",
    "REJECTED": "Verification rejected",
    "SERVICE_HEALTHY": "All upstream services healthy",
    "SERVICE_DEGRADED": "Upstream service degraded",
    "SERVICE_TIMEOUT": "Upstream service timed out",
    "RATE_LIMITED": "Client rate-limited",
    "INTERNAL_ERROR": "Internal server error",
}


def description(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in DESCRIPTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit("Unknown code"))


def severity(code: Column) -> Column:
    return reduce(lambda c, kv: c.when(code.isin(*kv[1]), kv[0]), REASON_CODES.items(), F.when(F.lit(False), "")).otherwise("info")


def _or(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def _majority(decisions: Column) -> Column:
    """Share of the most frequent decision."""
    return F.array_max(F.transform(decisions, lambda d: F.size(F.filter(decisions, lambda x: x == d)))) / F.size(decisions)


def signals() -> Column:
    """The ten values of 0 to 1, by the names of RISK_WEIGHTS less the two scores
    that the rules adjust, with 0.5 where nothing is known."""
    doc, face, live, ai = F.col("document"), F.col("face"), F.col("liveness"), F.col("ai_consensus")
    have = F.map_values(doc["features"])
    match = F.when(_or(face["is_match"], False), clamp(_or(face["similarity"], 0.0))).otherwise(0.0)
    real = clamp(1 - clamp(_or(live["pad_score"], 1.0)))
    agree = F.when(ai["confidence"].isNotNull(), clamp(ai["confidence"])).when(F.size(_or_empty(ai["decisions"])) > 0, _majority(ai["decisions"])).otherwise(0.5)
    return F.struct(
        clamp(_or(doc["confidence"], 0.5)).alias("document_authenticity"),
        F.when(have.isNotNull(), F.size(F.filter(have, lambda v: v)) / F.greatest(F.size(have), F.lit(1))).otherwise(0.0).alias("document_authenticity_features"),
        clamp(_or(doc["ocr_confidence"], 0.5)).alias("ocr_confidence"),
        clamp(_or(F.col("cross_field")["consistency"], 0.5)).alias("cross_field_consistency"),
        match.alias("face_match_confidence"),
        real.alias("liveness_confidence"),
        clamp(_or(F.col("device")["trust_score"], 0.5)).alias("device_signals"),
        agree.alias("ai_consensus_confidence"),
    )


def _or_empty(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def evaluate(approve: float = 0.80, review: float = 0.60) -> Column:
    """A struct of ``score``, ``decision``, ``codes`` in order and ``factors``
    (factor, weight, value, contribution).

    A critical code rejects whatever the score; the score is the weighted mean of
    all factors, the device's only if there is one.
    """
    return bound(signals(), lambda s: _evaluated(s, approve, review))


def _evaluated(s: Column, approve: float, review: float) -> Column:
    doc, face, live, cross, ai = F.col("document"), F.col("face"), F.col("liveness"), F.col("cross_field"), F.col("ai_consensus")
    tampering, mrz = _or(doc["tampering"], 0.0), _or(doc["mrz_valid"], True)
    doc_score = F.when(tampering > 0.3, 0.0).otherwise(s["document_authenticity"] * (1 - tampering) * F.when(mrz, 1.0).otherwise(0.5))
    features = F.coalesce(doc["features"], F.create_map().cast("map<string,boolean>"))
    missing = F.map_keys(F.map_filter(features, lambda k, v: ~F.coalesce(v, F.lit(False))))
    no_face = ~_or(face["detected"], True) & ~_or(face["has_embedding"], False)
    matched, alike, quality = _or(face["is_match"], False), _or(face["similarity"], 0.0), _or(face["quality"], 0.5)
    face_score = F.when(no_face, 0.0).when(matched, F.least(F.lit(1.0), alike * 1.2)).otherwise(alike * 0.3) * F.when(quality < 0.4, 0.7).otherwise(1.0)
    is_live, pad = _or(live["is_live"], False), _or(live["pad_score"], 1.0)
    live_score = F.when(is_live, 1 - pad).otherwise(0.0)
    said = F.size(_or_empty(ai["decisions"])) > 0
    flagged = lambda name: F.array_contains(_or_empty(cross["flags"]), f"CROSS_FIELD_{name}_MISMATCH")
    ocr, agree, trust = s["ocr_confidence"], s["ai_consensus_confidence"], s["device_signals"]
    has_face, has_live, has_device, has_cross, has_ai = (F.col(c).isNotNull() for c in ("face", "liveness", "device", "cross_field", "ai_consensus"))
    low = lambda c: _or(live[c], 1.0) < 0.3
    found = [
        ("DOC_MRZ_INVALID", ~mrz),
        ("DOC_TAMPERED", tampering > 0.3),
        ("DOC_PASS", (tampering <= 0.3) & (s["document_authenticity"] > 0.7)),
        ("DOC_LOW_CONFIDENCE", (tampering <= 0.3) & (s["document_authenticity"] < 0.5)),
        ("DOC_GENUINE_SECURITY", (F.size(features) > 0) & (s["document_authenticity_features"] >= 0.7)),
        *[(f"DOC_{n}_MISSING", F.array_contains(missing, f)) for f, n in (("hologram", "HOLOGRAM"), ("watermark", "WATERMARK"), ("microprint", "MICROPRINT"), ("uv", "UV_FEATURE"))],
        ("DOC_SECURITY_FEATURE_MISSING", F.size(missing) >= 3),
        ("FACE_NO_FACE", has_face & no_face),
        ("FACE_MATCH", has_face & ~no_face & matched),
        ("FACE_MISMATCH", has_face & ~no_face & ~matched),
        ("FACE_LOW_QUALITY", has_face & (quality < 0.4)),
        ("FACE_HIGH_QUALITY", has_face & (quality >= 0.8)),
        ("LIVE_CONFIRMED", has_live & is_live),
        ("LIVE_FAILED", has_live & ~is_live),
        ("LIVE_PAD_SCORE_HIGH", has_live & ~is_live & (pad > 0.5)),
        ("LIVE_TEXTURE_ANOMALY", has_live & low("texture")),
        ("LIVE_MOIRE_DETECTED", has_live & low("frequency")),
        ("LIVE_DEPTH_FLAT", has_live & low("depth")),
        ("DEVICE_TRUSTED", has_device & (trust >= 0.7)),
        ("DEVICE_LOW_TRUST", has_device & (trust < 0.5)),
        ("CROSS_FIELD_PASS", has_cross & (s["cross_field_consistency"] >= 0.9)),
        *[(f"CROSS_FIELD_{n}_MISMATCH", flagged(n)) for n in ("NAME", "DOB", "GENDER", "NATIONALITY")],
        ("AI_CONSENSUS_AGREE", said & (agree >= 0.9)),
        ("AI_CONSENSUS_SPLIT", said & (agree >= 0.6) & (agree < 0.9)),
        ("AI_CONSENSUS_DISAGREE", said & (agree < 0.6)),
        ("AI_CONSENSUS_INSUFFICIENT", has_ai & ~said),
        ("OCR_SUCCESS", ocr >= 0.85),
        ("OCR_GARBLED", ocr < 0.5),
        ("OCR_LOW_CONFIDENCE", (ocr >= 0.5) & (ocr < 0.7)),
    ]
    codes = F.array_compact(F.array(*[F.when(when, F.lit(code)) for code, when in found]))
    values = {"document_authenticity": doc_score, "face_match": F.when(has_face, face_score).otherwise(0.0), "liveness": F.when(has_live, live_score).otherwise(0.0)}
    parts = [(n, w, values.get(n, s[n] if n not in values else None)) for n, w in RISK_WEIGHTS.items()]
    factors = F.array_compact(F.array(*[F.when(has_device if n == "device_signals" else F.lit(True), F.struct(F.lit(n).alias("factor"), F.lit(w).alias("weight"), v.cast("double").alias("value"), (v * w).cast("double").alias("contribution"))) for n, w, v in parts]))
    total = lambda fs, c: F.aggregate(fs, F.lit(0.0), lambda a, f: a + f[c])

    def decided(x: Column) -> Column:
        score = x["sum"] / x["weights"]
        critical = F.arrays_overlap(x["codes"], F.array(*map(F.lit, REASON_CODES["critical"])))
        decision = F.when(critical, "reject").when(score >= approve, "approve").when(score >= review, "review").otherwise("reject")
        last = F.when(decision == "approve", "APPROVED").when(decision == "review", "REVIEW_NEEDED").otherwise("REJECTED")
        return F.struct(half_up(score, 4).alias("score"), decision.alias("decision"), F.concat(x["codes"], F.array(last)).alias("codes"), x["factors"].alias("factors"))

    summed = bound(factors, lambda fs: F.struct(total(fs, "contribution").alias("sum"), total(fs, "weight").alias("weights"), fs.alias("factors")))
    return bound(summed, lambda f: bound(F.struct(f["sum"].alias("sum"), f["weights"].alias("weights"), f["factors"].alias("factors"), codes.alias("codes")), decided))
