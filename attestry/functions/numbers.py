"""Arithmetic with half-up rounding and bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def half_up(x, places: int = 0) -> Column:
    """Rounds halves towards positive infinity (-2.5 gives -2)."""
    scale = 10.0**places
    return F.floor(_col(x) * scale + 0.5) / scale


def clamp(x, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _col(x)))


def lerp(a, b, t) -> Column:
    return _col(a) + (_col(b) - _col(a)) * _col(t)


def remap(x, low: float, high: float) -> Column:
    """Place of x between two bounds, 0..1."""
    return clamp((_col(x) - low) / (high - low))


def ratio(a, b) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(_col(a).cast("double"), _col(b).cast("double")), F.lit(0.0))


def sigmoid(x) -> Column:
    x = _col(x)
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def l2_similarity(a, b) -> Column:
    """0..100; distance 0.6 and more is 0."""
    return clamp((1 - l2(a, b) / 0.6) * 100, 0.0, 100.0)


def linear_model(features, weights: list[float], bias: float = 0.0) -> Column:
    """Probability of a logistic model; missing features count as 0, extra ones are dropped."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    have = F.slice(_col(features), 1, len(weights))
    return sigmoid(dot(w, have) + F.lit(float(bias)))


def mean(a) -> Column:
    """Mean of an array, 0 if it is empty."""
    a = _col(a)
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(a)).otherwise(F.lit(0.0))


def _around(a: Column, m: Column) -> Column:
    """Population standard deviation about a mean that is known."""
    total = F.aggregate(a, F.lit(0.0), lambda s, v: s + (v.cast("double") - m) * (v.cast("double") - m))
    return F.when(F.size(a) > 0, F.sqrt(total / F.size(a))).otherwise(F.lit(0.0))


def deviation(a) -> Column:
    """Population standard deviation of an array, 0 if it is empty.  Two passes: sums
    of squares less the square of the sum would lose all digits where values are alike."""
    a = _col(a)
    return bound(mean(a), lambda m: _around(a, m))


def bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def with_stats(values, then) -> Column:
    """``then(mean, deviation)`` of an array."""
    v = _col(values)
    return bound(mean(v), lambda m: bound(_around(v, m), lambda s: then(m, s)))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    p1, p2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    dp, dl = p2 - p1, F.radians(_col(lon2)) - F.radians(_col(lon1))
    h = F.sin(dp / 2) * F.sin(dp / 2) + F.cos(p1) * F.cos(p2) * F.sin(dl / 2) * F.sin(dl / 2)
    return F.lit(2 * 6371.0) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def iou(a, b) -> Column:
    """Overlap of two boxes (structs x, y, w, h) over their union."""
    a, b = _col(a), _col(b)
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    both = w * h
    return ratio(both, a["w"] * a["h"] + b["w"] * b["h"] - both)


def centre_distance(a, b) -> Column:
    a, b = _col(a), _col(b)
    dx, dy = a["x"] + a["w"] / 2 - b["x"] - b["w"] / 2, a["y"] + a["h"] / 2 - b["y"] - b["h"] / 2
    return F.sqrt(dx * dx + dy * dy)


def years_between(start, end) -> Column:
    """Years of 365.25 days."""
    return F.datediff(_col(end), _col(start)) / 365.25
