"""Presentation-attack detectors over feature arrays, in higher-order functions.

Each returns a struct ``type``, ``score``, ``confidence``; missing input gives
the neutral (0.1, 0.1), and for gradients (0, 0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions.numbers import bound, clamp, deviation, half_up, mean, ratio, with_stats
from attestry.operators.fusion import detector_confidence, local_peaks, soft_or


def _of(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def evidence_strength(values) -> Column:
    v = F.coalesce(_of(values), F.array().cast("array<double>"))
    return F.when(F.size(v) == 0, 0.0).otherwise(clamp(F.size(v) / 512) * 0.5 + clamp(deviation(v) / 50) * 0.5)


def _signal(kind: str, score: Column, evidence: Column) -> Column:
    return bound(clamp(score), lambda s: F.struct(F.lit(kind).alias("type"), s.alias("score"), detector_confidence(s, evidence).alias("confidence")))


def _fixed(kind: str, score: float, confidence: float) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(score).alias("score"), F.lit(confidence).alias("confidence"))


def _given(values) -> Column:
    return F.coalesce(F.size(_of(values)), F.lit(0)) > 0


def _share(values, test) -> Column:
    v = _of(values)
    return F.size(F.filter(v, test)) / F.size(v)


def _steps(*arms: tuple[Column, float]) -> Column:
    out = F.when(arms[0][0], arms[0][1])
    for when, value in arms[1:]:
        out = out.when(when, value)
    return F.coalesce(out.otherwise(0.0), F.lit(0.0))


def deepfake(frequency, histogram, size_bytes) -> Column:
    f, h = _of(frequency), _of(histogram)
    spectrum = with_stats(f, lambda m, s: _steps(((ratio(s, m) < 0.15) & (m > 5), 0.35), ((m > 50) & (s < 5), 0.25), (m < 2, 0.15)))
    colours = with_stats(h, lambda m, s: _steps((s < 2, 0.25)) + _steps(((m > 200) | ((m > 0) & (ratio(s, m) < 0.05)), 0.15)))
    small = _steps((_of(size_bytes).between(1, 4999), 0.1))
    score = F.when(_given(f), spectrum).otherwise(0.0) + F.when(_given(h), colours).otherwise(0.0) + small
    return _signal("deepfake", score, (evidence_strength(f) + evidence_strength(h)) / 2)


def mask_3d(depth) -> Column:
    d = _of(depth)
    at = F.when(F.size(d) > 1, F.sequence(F.lit(2), F.size(d))).otherwise(F.array().cast("array<int>"))
    breaks = lambda m: F.size(F.filter(at, lambda i: F.abs(F.element_at(d, i) - F.element_at(d, i - 1)) > m * 2)) / F.size(d)
    score = with_stats(d, lambda m, s: _steps((ratio(s, m) < 0.05, 0.4), (ratio(s, m) < 0.1, 0.2)) + _steps((breaks(m) > 0.1, 0.3)))
    return F.when(_given(d), _signal("3d_mask", score, evidence_strength(d))).otherwise(_fixed("3d_mask", 0.1, 0.1))


def screen_replay(spectrum) -> Column:
    v = _of(spectrum)
    spikes = with_stats(v, lambda m, s: bound(_share(v, lambda x: x - m > 3 * s), lambda r: _steps((r > 0.05, 0.4), (r > 0.02, 0.2))))
    half = F.floor(F.size(v) / 2).cast("int")
    low = mean(F.slice(v, 1, F.floor(half / 4).cast("int")))
    high = mean(F.slice(v, half + 1, F.greatest(F.size(v) - half, F.lit(0))))
    energy = bound(ratio(high, low), lambda r: _steps((r > 0.5, 0.35), (r > 0.2, 0.15)))
    return F.when(_given(v), _signal("screen_replay", spikes + energy, evidence_strength(v))).otherwise(_fixed("screen_replay", 0.1, 0.1))


def print_attack(texture) -> Column:
    v = _of(texture)
    flat = with_stats(v, lambda m, s: bound(ratio(s, m), lambda r: _steps((r < 0.1, 0.3), (r < 0.2, 0.1))))

    def regular(peaks: Column) -> Column:
        steps = F.when(F.size(peaks) > 1, F.sequence(F.lit(2), F.size(peaks))).otherwise(F.array().cast("array<int>"))
        gaps = F.transform(steps, lambda i: (F.element_at(peaks, i) - F.element_at(peaks, i - 1)).cast("double"))
        even = bound(gaps, lambda g: with_stats(g, lambda m, s: (F.size(peaks) >= 3) & (m > 0) & (ratio(s, m) < 0.2)))
        return _steps((even & (F.size(peaks) >= 5), 0.4), (F.size(peaks) >= 5, 0.15))

    score = flat + bound(local_peaks(v), regular)
    return F.when(_given(v), _signal("print_attack", score, evidence_strength(v))).otherwise(_fixed("print_attack", 0.1, 0.1))


def silicone(ridges) -> Column:
    v = _of(ridges)

    def score(m: Column, s: Column) -> Column:
        flat = bound(ratio(s, m), lambda r: _steps((r < 0.05, 0.4), (r < 0.1, 0.2)))
        dips = bound(_share(v, lambda x: x < m - s), lambda r: _steps((r < 0.02, 0.35), (r < 0.05, 0.15)))
        return flat + dips + _steps((F.size(F.filter(v, lambda x: x > m + 3 * s)) >= 3, 0.25))

    return F.when(_given(v), _signal("silicone_finger", with_stats(v, score), evidence_strength(v))).otherwise(_fixed("silicone_finger", 0.1, 0.1))


def fgsm(gradient, epsilon) -> Column:
    g, e = _of(gradient), _of(epsilon)
    plus, minus = F.size(F.filter(g, lambda x: x > 0)), F.size(F.filter(g, lambda x: x < 0))
    balance = F.when(plus + minus == 0, 0.5).otherwise(plus / (plus + minus))
    near = _share(g, lambda x: F.abs(x).between(0.9 * e, 1.1 * e))
    score = _steps((F.abs(balance - 0.5) < 0.05, 0.3)) + _steps((near > 0.7, 0.5), (near > 0.4, 0.25))
    return F.when(_given(g) & (e > 0), _signal("fgsm", score, evidence_strength(g))).otherwise(_fixed("fgsm", 0.0, 0.0))


def perturbation(l2, linf, entropy) -> Column:
    a, b, c = _of(l2), _of(linf), _of(entropy)
    score = _steps(((a > 1) & (a < 20), 0.3)) + _steps(((b > 0.01) & (b < 0.5), 0.3)) + _steps((c > 5, 0.25), (c > 3, 0.1))
    evidence = clamp(_steps((a > 0, 0.3)) + _steps((b > 0, 0.3)) + _steps((c > 0, 0.3)) + 0.1)
    return _signal("perturbation", score, evidence)


def hybrid(signals) -> Column:
    """Soft-or of all signals, with a bonus for several moderate ones of
    different types."""
    s = _of(signals)
    moderate = F.size(F.filter(s, lambda x: (x["score"] >= 0.2) & (x["score"] < 0.6)))
    kinds = F.size(F.array_distinct(F.transform(s, lambda x: x["type"])))
    bonus = F.when((moderate >= 2) & (kinds >= 2), 0.15 * F.least(F.lit(3), moderate)).otherwise(0.0)
    score = soft_or(F.transform(s, lambda x: x["score"])) + bonus
    return F.when(F.size(s) > 0, _signal("hybrid", score, F.least(F.lit(1.0), F.size(s) / 5))).otherwise(_fixed("hybrid", 0.0, 0.0))


def battery(frequency="frequency", histogram="histogram", depth="depth", spectrum="spectrum", texture="texture", fingerprint="fingerprint", gradient="gradient", epsilon="epsilon", l2="l2", linf="linf", entropy="entropy", size_bytes="size_bytes") -> Column:
    """Deepfake, screen and print always (neutral without input), the others if their
    input is there, an empty array too; the hybrid of them all comes last."""
    some = F.array_compact(
        F.array(
            deepfake(frequency, histogram, size_bytes),
            F.when(_of(depth).isNotNull(), mask_3d(depth)),
            screen_replay(spectrum),
            print_attack(texture),
            F.when(_of(fingerprint).isNotNull(), silicone(fingerprint)),
            F.when(_of(gradient).isNotNull() & _of(epsilon).isNotNull(), fgsm(gradient, epsilon)),
            F.when(_of(l2).isNotNull(), perturbation(l2, linf, entropy)),
        )
    )
    return bound(some, lambda d: F.concat(d, F.array(hybrid(d))))


#: Weights of the nine signals of a presentation-attack score.
PAD_WEIGHTS = {"optical_flow": 0.18, "lbp_texture": 0.15, "fft_moire": 0.15, "colour": 0.10, "depth": 0.15, "specular": 0.10, "print": 0.07, "screen": 0.05, "depth_check": 0.05}


def pad_score(signals: dict[str, Column]) -> Column:
    total = None
    for name, weight in PAD_WEIGHTS.items():
        part = F.coalesce(signals[name], F.lit(0.0)) * weight
        total = part if total is None else total + part
    return clamp(total)


def liveness_total(parts: list[Column], pad: Column) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return clamp(half_up(total + (pad - 0.5) * 20), 0.0, 100.0)


def is_live(total: Column, pad: Column, motion: Column, challenge: Column, static: Column, moire: Column) -> Column:
    return ((total >= 60) & motion & challenge & ~static & ~moire) | ((pad >= 0.65) & motion & challenge)


def liveness_signals(signals: dict[str, Column]) -> Column:
    """Weighted mean of (1 - s) over the signals that are there."""
    weights = {"texture": 0.20, "frequency": 0.20, "depth": 0.15, "motion": 0.25, "deepfake": 0.20}
    num, den = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        if name in signals:
            num = num + F.coalesce((1 - signals[name]) * w, F.lit(0.0))
            den = den + F.when(signals[name].isNotNull(), w).otherwise(0.0)
    pad = ratio(num, den)
    return F.struct(half_up(pad, 4).alias("pad"), (pad < 0.5).alias("live"), half_up(F.abs(pad - 0.5) * 2, 4).alias("confidence"))
