"""Evidence fusion: modality scores, belief combination, detectors, decisions.

Everything is column arithmetic and folds over arrays, one row a case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.numbers import bound, clamp, half_up, mean, ratio, remap, with_stats

MODALITIES = ("face", "voice", "behavioral", "document", "device")

#: Weights by risk level, in the order of MODALITIES.
BASE_WEIGHTS = {"medium": (0.35, 0.20, 0.15, 0.25, 0.05), "high": (0.40, 0.20, 0.05, 0.30, 0.05), "low": (0.45, 0.15, 0.15, 0.20, 0.05)}

#: What a device type adds.
DEVICE_SHIFT = {"mobile": (-0.03, -0.02, 0.05, 0.0, 0.0), "desktop": (0.03, 0.0, -0.05, 0.0, 0.02), "kiosk": (0.0, -0.05, -0.08, 0.03, 0.10)}

#: Ensemble weights of attack types.
ATTACK_WEIGHTS = {"deepfake": 1.2, "3d_mask": 1.1, "silicone_finger": 1.0, "screen_replay": 1.0, "print_attack": 0.9, "hybrid": 1.3, "fgsm": 1.4, "perturbation": 1.0}


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def _sum(*parts: Column) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def face_score(match="face_match", live="liveness", quality="face_quality", blink="blink", pose="head_pose", expression="expression") -> Column:
    gate = F.when(_c(quality) >= 0.4, 1.0).otherwise(_c(quality) / 0.4)
    return clamp((_c(match) * 0.45 + _c(live) * 0.35 + (_c(blink) * 0.5 + _c(pose) * 0.3 + _c(expression) * 0.2) * 0.20) * gate)


def face_confidence(live="liveness", quality="face_quality", landmarks="landmarks") -> Column:
    return clamp(0.95 * F.least(_c(quality), _c(live), F.lit(1.0)) + 0.05 * _c(landmarks))


def voice_score(similarity="voice_similarity", pitch="pitch_mean", pitch_std="pitch_std", snr="snr", rate="speech_rate", pause="pause", emotion="emotion") -> Column:
    band = F.when(_c(pitch).between(85, 255), 1.0).otherwise(remap(_c(pitch), 50, 300))
    spread = 0.3 + 0.7 * remap(_c(pitch_std), 0, 80)
    return clamp(_c(similarity) * 0.60 + _sum(band, spread, remap(_c(snr), 5, 40), remap(_c(rate), 60, 220), _c(pause), _c(emotion)) / 6 * 0.40)


def _duration(name: str) -> Column:
    return F.when(_c(name) < 10, _c(name) / 10 * 0.5).otherwise(0.5 + 0.5 * remap(_c(name), 10, 300))


def behavioral_score(keys="keystroke", mouse="mouse_entropy", scroll="scroll", touch="touch", angle="angle", duration="duration") -> Column:
    return clamp(clamp(_c(keys)) * 0.35 + remap(_c(mouse), 0, 5) * 0.20 + clamp(_c(scroll)) * 0.15 + clamp(_c(touch)) * 0.10 + clamp(_c(angle)) * 0.10 + _duration(duration) * 0.10)


def document_score(mrz="mrz_valid", tamper="tampering_score", cross="cross_field_rate", ocr="ocr_confidence", features="security_features", age="document_age", font="font") -> Column:
    aged = F.when(_c(age) < 1, 0.5).when(_c(age) < 3650, 1.0).otherwise(1.0 - 0.5 * remap(_c(age), 3650, 36500))
    return clamp(clamp(_c(mrz)) * 0.25 + clamp(_c(tamper)) * 0.25 + clamp(_c(cross)) * 0.20 + clamp(_c(ocr)) * 0.10 + remap(_c(features), 0, 5) * 0.10 + aged * 0.05 + clamp(_c(font)) * 0.05)


def device_score(attestation="attestation", integrity="integrity", reputation="reputation") -> Column:
    return clamp(_c(attestation) * 0.40 + _c(integrity) * 0.35 + _c(reputation) * 0.25)


def weights(risk="risk", device="device_type", age="session_age") -> Column:
    """Adaptive weights as an array in the order of MODALITIES, summing to 1."""
    pick = lambda table, key, default: [F.coalesce(*[F.when(F.col(key) == k, F.lit(float(v[i]))) for k, v in table.items()], F.lit(float(default[i]))) for i in range(5)]
    base = pick(BASE_WEIGHTS, risk, BASE_WEIGHTS["medium"])
    shift = pick(DEVICE_SHIFT, device, (0,) * 5)
    old, new = (-0.03, 0.0, 0.05, -0.02, 0.0), (0.03, 0.0, -0.05, 0.02, 0.0)
    aged = [F.when(_c(age) > 600, a).when(_c(age) < 30, b).otherwise(0.0) for a, b in zip(old, new, strict=True)]
    raw = F.array(*[F.greatest(F.lit(0.001), b + s + g) for b, s, g in zip(base, shift, aged, strict=True)])
    return F.transform(raw, lambda w: w / F.aggregate(raw, F.lit(0.0), lambda s, v: s + v))


def combine_beliefs(evidence) -> Column:
    """Pairwise fold of (hypothesis, probability, uncertainty) in array order.

    A struct of ``real``, ``spoof`` and ``conflict``; the conflict is that of the
    last pair.  Nothing gives (0.5, 0.5, 0), total conflict (0.5, 0.5, 1).
    """
    evidence = F.col(evidence) if isinstance(evidence, str) else evidence

    def masses(e: Column) -> Column:
        p = clamp(e["probability"])
        u = F.greatest(F.lit(0.0), F.least(clamp(e["uncertainty"]), 1 - p))
        o = clamp(1 - p - u)
        real = e["hypothesis"] == "real"
        return F.struct(F.when(real, p).otherwise(o).alias("real"), F.when(real, o).otherwise(p).alias("spoof"), u.alias("open"))

    def state(real, spoof, open_, conflict) -> Column:
        return F.struct(real.alias("real"), spoof.alias("spoof"), open_.alias("open"), conflict.alias("conflict"))

    def step(acc: Column, e: Column) -> Column:
        k = acc["real"] * e["spoof"] + acc["spoof"] * e["real"]
        real = acc["real"] * e["real"] + acc["real"] * e["open"] + acc["open"] * e["real"]
        spoof = acc["spoof"] * e["spoof"] + acc["spoof"] * e["open"] + acc["open"] * e["spoof"]
        open_ = acc["open"] * e["open"]

        def scaled(t: Column) -> Column:
            # 1 - k, but without its rounding errors, which grow from item to item.
            return bound(t["real"] + t["spoof"] + t["open"], lambda norm: F.when(norm > 1e-9, state(t["real"] / norm, t["spoof"] / norm, t["open"] / norm, t["conflict"])).otherwise(state(F.lit(0.5), F.lit(0.5), F.lit(0.0), F.lit(1.0))))

        return bound(state(real, spoof, open_, k), scaled)

    def fold(all_masses: Column) -> Column:
        head = F.element_at(all_masses, 1)
        return F.aggregate(F.slice(all_masses, 2, F.greatest(F.size(all_masses) - 1, F.lit(0))), state(head["real"], head["spoof"], head["open"], F.lit(0.0)), step)

    def finished(folded: Column) -> Column:
        total = folded["real"] + folded["spoof"] + folded["open"]
        return bound(total, lambda t: F.struct((folded["real"] / t).alias("real"), (folded["spoof"] / t).alias("spoof"), folded["conflict"].alias("conflict")))

    # Masses and their fold are lambda variables: as plain expressions they would be written out, and computed, for each field of the result.
    done = bound(F.transform(evidence, masses), lambda m: bound(fold(m), finished))
    none = F.struct(F.lit(0.5).alias("real"), F.lit(0.5).alias("spoof"), F.lit(0.0).alias("conflict"))
    return F.when(F.size(evidence) > 0, done).otherwise(none)


def evidence_of(scores) -> Column:
    """Modality scores (score, confidence) as evidence for ``combine_beliefs``."""
    return F.transform(
        F.col(scores) if isinstance(scores, str) else scores,
        lambda s: F.struct(F.when(s["score"] >= 0.5, "real").otherwise("spoof").alias("hypothesis"), F.when(s["score"] >= 0.5, s["score"]).otherwise(1 - s["score"]).alias("probability"), clamp(1 - s["confidence"]).alias("uncertainty")),
    )


def fused_decision(fused: Column, conflict: Column) -> Column:
    return F.when((fused >= 0.70) & (conflict < 0.30), "approve").when((fused < 0.40) | (conflict > 0.60), "reject").otherwise("review")


def disagreement(scores) -> Column:
    """Mean over conflicting pairs of |difference| x both confidences."""
    scores = F.col(scores) if isinstance(scores, str) else scores
    split = lambda a, b: (a["score"] >= 0.5) != (b["score"] >= 0.5)
    pairs = F.flatten(F.transform(scores, lambda a, i: F.transform(F.filter(scores, lambda b, j: (j > i) & split(a, b)), lambda b: F.abs(a["score"] - b["score"]) * a["confidence"] * b["confidence"])))
    return clamp(mean(pairs))


def risk_level(fused: Column, conflict: Column) -> Column:
    r = clamp(1 - fused + 0.5 * conflict)
    return F.when(r < 0.20, "low").when(r < 0.45, "medium").when(r < 0.70, "high").otherwise("critical")


def step_up(current, failed, risk) -> Column:
    """Failed modalities first, then missing ones by priority; 3 at most, and
    below high risk no more than 2 by adding."""
    current, failed, risk = (F.col(c) for c in (current, failed, risk))
    first = F.array_distinct(failed)
    more = F.array_except(F.array_except(F.array(*[F.lit(m) for m in ("face", "document", "voice", "behavioral", "device")]), current), first)
    room = F.greatest(F.lit(0), F.when(risk.isin("high", "critical"), 3).when(risk == "medium", 2).otherwise(0) - F.size(first))
    return F.slice(F.concat(first, F.slice(more, 1, room)), 1, 3)


def soft_or(scores) -> Column:
    """1 - product of (1 - s)."""
    return 1 - F.aggregate(F.col(scores) if isinstance(scores, str) else scores, F.lit(1.0), lambda p, s: p * (1 - clamp(s)))


def detector_confidence(score: Column, evidence: Column) -> Column:
    return clamp(0.3 + 0.5 * F.abs(score - 0.5) + 0.2 * evidence)


def ensemble(detections) -> Column:
    """Detections (type, score, confidence) to score, verdict, band, action and
    fingerprint: the types of score 0.2 and more among the three detections with
    the largest score x confidence (ties in order)."""
    d = F.col(detections) if isinstance(detections, str) else detections
    weight = F.map_from_arrays(F.array(*map(F.lit, ATTACK_WEIGHTS)), F.array(*map(F.lit, ATTACK_WEIGHTS.values())))
    w = lambda x: F.coalesce(F.try_element_at(weight, x["type"]), F.lit(1.0))
    ranked = F.array_sort(F.transform(d, lambda x, i: F.struct((-x["score"] * x["confidence"]).alias("k"), i.alias("i"), x["type"].alias("type"), x["score"].alias("score"), x["confidence"].alias("confidence"))))
    # Added up in order of rank, by which the last digit of the score is the same for any order of detections.
    score = clamp(ratio(F.aggregate(ranked, F.lit(0.0), lambda s, x: s + x["score"] * x["confidence"] * w(x)), F.aggregate(ranked, F.lit(0.0), lambda s, x: s + x["confidence"] * w(x))))
    kinds = F.array_distinct(F.transform(F.filter(F.slice(ranked, 1, 3), lambda x: x["score"] >= 0.2), lambda x: x["type"]))
    return F.struct(
        score.alias("score"),
        (score >= 0.5).alias("adversarial"),
        F.when(score >= 0.7, "critical").when(score >= 0.5, "high").when(score >= 0.3, "medium").otherwise("low").alias("band"),
        clamp(mean(F.transform(d, lambda x: x["confidence"])) + F.when(F.size(kinds) >= 2, 0.15).otherwise(0.0)).alias("confidence"),
        kinds.alias("fingerprint"),
        F.when(score >= 0.7, "reject").when(score >= 0.3, "review").otherwise("allow").alias("action"),
    )


def local_peaks(values) -> Column:
    """Places above both neighbours and over mean + deviation."""
    v = F.col(values) if isinstance(values, str) else values
    at = F.sequence(F.lit(2), F.greatest(F.size(v) - 1, F.lit(2)))
    high = lambda bar: F.filter(at, lambda i: (F.element_at(v, i) > bar) & (F.element_at(v, i) > F.element_at(v, i - 1)) & (F.element_at(v, i) > F.element_at(v, i + 1)))
    return F.when(F.size(v) < 3, F.array().cast("array<int>")).otherwise(with_stats(v, lambda m, s: high(m + s)))


def tampering(exif: Column, ela: Column, noise: Column, clone: Column) -> Column:
    return F.least(F.lit(1.0), 0.2 * exif + 0.3 * ela + 0.25 * noise + 0.35 * clone)


def case_scores(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select("*", *[half_up(c, 6).alias(n) for c, n in zip(columns, (f"s{i}" for i in range(len(columns))), strict=True)])
