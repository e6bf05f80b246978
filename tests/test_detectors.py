"""Every attack detector and the battery against statements in plain Python."""

import random
from statistics import fmean, pstdev

import pytest

from attestry.operators import detectors, fusion

SCHEMA = "i int, frequency array<double>, histogram array<double>, depth array<double>, spectrum array<double>, texture array<double>, fingerprint array<double>, gradient array<double>, epsilon double, l2 double, linf double, entropy double, size_bytes int"


def stats(v):
    m = fmean(v) if v else 0.0
    s = pstdev(v) if v else 0.0
    return m, s, s / m if m else 0.0


def unit(x):
    return min(1.0, max(0.0, x))


def amount(v):
    return unit(len(v) / 512) / 2 + unit(stats(v)[1] / 50) / 2 if v else 0.0


def told(kind, score, evidence):
    return kind, unit(score), unit(0.3 + abs(unit(score) - 0.5) / 2 + evidence / 5)


def first(*arms):
    """The value of the first condition that holds."""
    return next((value for holds, value in arms if holds), 0.0)


def deepfake(r):
    f, h = r["frequency"], r["histogram"]
    score = 0.1 if 0 < (r["size_bytes"] or 0) < 5000 else 0.0
    if f:
        m, s, spread = stats(f)
        score += first((spread < 0.15 and m > 5, 0.35), (m > 50 and s < 5, 0.25), (m < 2, 0.15))
    if h:
        m, s, spread = stats(h)
        score += 0.25 * (s < 2) + 0.15 * (m > 200 or (m > 0 and spread < 0.05))
    return told("deepfake", score, (amount(f) + amount(h)) / 2)


def mask(v):
    if not v:
        return "3d_mask", 0.1, 0.1
    m, _, relief = stats(v)
    jumps = sum(abs(b - a) > 2 * m for a, b in zip(v, v[1:]))
    return told("3d_mask", first((relief < 0.05, 0.4), (relief < 0.1, 0.2)) + 0.3 * (jumps / len(v) > 0.1), amount(v))


def screen(v):
    if not v:
        return "screen_replay", 0.1, 0.1
    m, s, _ = stats(v)
    spikes, half = sum(x - m > 3 * s for x in v) / len(v), len(v) // 2
    low, high = v[: half // 4], v[half:]
    rest = (fmean(high) if high else 0.0) / fmean(low) if low and fmean(low) else 0.0
    return told("screen_replay", first((spikes > 0.05, 0.4), (spikes > 0.02, 0.2)) + first((rest > 0.5, 0.35), (rest > 0.2, 0.15)), amount(v))


def printed(v):
    if not v:
        return "print_attack", 0.1, 0.1
    m, s, spread = stats(v)
    peaks = [i for i in range(1, len(v) - 1) if v[i] > max(v[i - 1], v[i + 1], m + s)]
    gaps = [b - a for a, b in zip(peaks, peaks[1:])]
    even = len(peaks) >= 3 and stats(gaps)[2] < 0.2
    return told("print_attack", first((spread < 0.1, 0.3), (spread < 0.2, 0.1)) + (len(peaks) >= 5) * (0.4 if even else 0.15), amount(v))


def silicone(v):
    if not v:
        return "silicone_finger", 0.1, 0.1
    m, s, spread = stats(v)
    dips = sum(x < m - s for x in v) / len(v)
    edges = sum(x > m + 3 * s for x in v)
    return told("silicone_finger", first((spread < 0.05, 0.4), (spread < 0.1, 0.2)) + first((dips < 0.02, 0.35), (dips < 0.05, 0.15)) + 0.25 * (edges >= 3), amount(v))


def fgsm(v, e):
    if not v or not e or e <= 0:
        return "fgsm", 0.0, 0.0
    up, down = sum(x > 0 for x in v), sum(x < 0 for x in v)
    share = up / (up + down) if up + down else 0.5
    near = sum(0.9 * e <= abs(x) <= 1.1 * e for x in v) / len(v)
    return told("fgsm", 0.3 * (abs(share - 0.5) < 0.05) + first((near > 0.7, 0.5), (near > 0.4, 0.25)), amount(v))


def perturbed(a, b, c):
    score = 0.3 * (1 < a < 20) + 0.3 * (0.01 < b < 0.5) + first((c > 5, 0.25), (c > 3, 0.1))
    return told("perturbation", score, unit(0.3 * (a > 0) + 0.3 * (b > 0) + 0.3 * (c > 0) + 0.1))


def hybrid(found):
    left = 1.0
    for _, score, _ in found:
        left *= 1 - score
    moderate = sum(0.2 <= score < 0.6 for _, score, _ in found)
    bonus = 0.15 * min(3, moderate) if moderate >= 2 and len({k for k, *_ in found}) >= 2 else 0.0
    return told("hybrid", 1 - left + bonus, min(1.0, len(found) / 5))


def battery(r):
    out = [deepfake(r)]
    if r["depth"] is not None:
        out.append(mask(r["depth"]))
    out += [screen(r["spectrum"] or []), printed(r["texture"] or [])]
    if r["fingerprint"] is not None:
        out.append(silicone(r["fingerprint"]))
    if r["gradient"] is not None and r["epsilon"] is not None:
        out.append(fgsm(r["gradient"], r["epsilon"]))
    if r["l2"] is not None:
        out.append(perturbed(r["l2"], r["linf"], r["entropy"]))
    return [*out, hybrid(out)]


def verdict(found):
    weigh = [fusion.ATTACK_WEIGHTS[k] * c for k, _, c in found]
    return unit(sum(s * w for (_, s, _), w in zip(found, weigh)) / sum(weigh)) if sum(weigh) else 0.0


def cases(rng, n):
    """Arrays that meet each condition: flat, uniform, spiky, regular, empty or missing ones."""

    def array(signed=False):
        kind, size = rng.randrange(9), rng.randrange(1, 60)
        base, width = rng.choice([0.5, 1.5, 8.0, 60.0, 220.0]), rng.choice([0.01, 0.04, 0.12, 0.5, 3])
        v = [base * (1 + rng.uniform(-width, width)) for _ in range(size)]
        if kind == 0:
            return None
        if kind == 1:
            return []
        if kind == 2:
            v = [base] * size
        if kind == 3:
            gap = rng.randrange(2, 7)
            v = [base * (9 if i % gap == 1 else 1) for i in range(size)]
        if kind == 4:
            v = [*v, *[base * 40] * rng.randrange(1, 5)]
        if kind == 5:
            v = [base / (1 + i) for i in range(size)]
        return [x * rng.choice([-1, 1]) for x in v] if signed else v

    for i in range(n):
        gradient = array(signed=True) if rng.random() < 0.5 else [rng.choice([-1, 1]) * rng.choice([0.03, 0.03, 0.03, 0.1]) for _ in range(40)]
        given = rng.random() < 0.7
        yield (i, *[array() for _ in range(6)], gradient, rng.choice([None, 0.0, 0.03, 8.0]), rng.choice([0.0, 0.5, 3.0, 25.0]) if given else None, rng.choice([0.0, 0.005, 0.1, 0.9]), rng.choice([0.0, 2.0, 4.0, 6.0]), rng.choice([None, 0, 1, 4999, 5000, 90_000]))


def test_battery(spark):
    rows = list(cases(random.Random(11), 600))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = df.withColumn("d", detectors.battery()).select("i", "d", fusion.ensemble("d").alias("v")).collect()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    seen = set()
    for r in out:
        want = battery(dict(zip(names, rows[r.i], strict=True)))
        assert [d.type for d in r.d] == [k for k, *_ in want]
        for d, (kind, score, confidence) in zip(r.d, want, strict=True):
            assert (d.score, d.confidence) == pytest.approx((score, confidence), abs=1e-9), (kind, rows[r.i])
            seen.add((kind, round(score, 3)) if kind != "hybrid" else kind)
        assert r.v.score == pytest.approx(verdict(want), abs=1e-9)
    # Each detector has shown several of its scores.
    for kind in fusion.ATTACK_WEIGHTS:
        assert kind == "hybrid" or len([s for s in seen if s[0] == kind]) >= 3, kind


def test_hybrid_alone(spark):
    df = spark.createDataFrame([(0, []), (1, [("a", 0.3, 0.5), ("a", 0.3, 0.5)]), (2, [("a", 0.3, 0.5), ("b", 0.3, 0.5)]), (3, [("a", 0.9, 0.5)])], "i int, d array<struct<type: string, score: double, confidence: double>>")
    got = {r.i: r.h for r in df.select("i", detectors.hybrid("d").alias("h")).collect()}
    assert tuple(got[0]) == ("hybrid", 0.0, 0.0)
    for i, found in ((1, [("a", 0.3, 0.5)] * 2), (2, [("a", 0.3, 0.5), ("b", 0.3, 0.5)]), (3, [("a", 0.9, 0.5)])):
        assert (got[i].score, got[i].confidence) == pytest.approx(hybrid(found)[1:])
