"""Canonical JSON: one text for one value, whatever order its keys came in.

``canonical`` writes a typed column (structs, maps and arrays at any depth) with
built-in functions; ``rewritten`` does it for JSON texts, whose shape no schema tells.

Keys are sorted at every depth, nulls are kept, nothing stands between tokens,
and numbers are written as JavaScript does (``1``, ``0.1``, ``1e+21``).  With ``keys``
only these keys appear, at every depth and in that order, as a list of names does
in ``JSON.stringify``: nested objects lose all others.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.numbers import bound

_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def text(value: Column) -> Column:
    """A string as a JSON string."""

    def escaped(s: Column) -> Column:
        out = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        control = out
        for c in map(chr, range(32)):
            control = F.replace(control, F.lit(c), F.lit(_SHORT.get(c, f"\\u{ord(c):04x}")))
        return F.concat(F.lit('"'), F.when(s.rlike(r"[\x00-\x1f]"), control).otherwise(out), F.lit('"'))

    return bound(value, escaped)


def number(value: Column) -> Column:
    """A double as JavaScript writes it; no number is null.  The digits are Java's,
    which for some doubles (beyond 1e21 most of all) are more than tell them apart."""

    def written(x: Column) -> Column:
        return bound(F.regexp_replace(F.abs(x).cast("string"), r"\.0(?=E|$)", ""), lambda s: placed(x, s))

    def placed(x: Column, s: Column) -> Column:
        # Digits without a point, and the place of the point among them.
        mantissa, power = F.regexp_extract(s, r"^([0-9.]+)", 1), F.coalesce(F.nullif(F.regexp_extract(s, r"E(-?\d+)", 1), F.lit("")).cast("int"), F.lit(0))
        whole = F.length(F.substring_index(mantissa, ".", 1))
        raw = F.replace(mantissa, F.lit("."), F.lit(""))
        zeros = F.length(raw) - F.length(F.regexp_replace(raw, "^0+", ""))
        digits = F.struct(F.regexp_replace(raw, "^0+|0+$", "").alias("d"), (whole + power - zeros).alias("p"))
        return bound(digits, lambda t: F.concat(F.when(x < 0, "-").otherwise(""), shaped(t["d"], t["p"])))

    def shaped(d: Column, p: Column) -> Column:
        n = F.length(d)
        point = lambda at: F.concat(F.substring(d, F.lit(1), at), F.lit("."), F.substring(d, at + 1, n))
        e = F.concat(F.when(n > 1, point(F.lit(1))).otherwise(d), F.lit("e"), F.when(p - 1 >= 0, "+").otherwise(""), (p - 1).cast("string"))
        return (
            F.when((p > 21) | (p < -5), e)
            .when(p >= n, F.rpad(d, p, "0"))
            .when(p > 0, point(p))
            .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -p), d))
        )

    usual = F.when(value == 0, "0").otherwise(written(value))
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "null").otherwise(usual)


def _order(name: str) -> bytes:
    return name.encode("utf-16-be", "surrogatepass")


def canonical(value: Column, kind: T.DataType, keys: Sequence[str] | None = None) -> Column:
    """JSON of a column of type ``kind``.  Map keys are sorted by their bytes."""
    match kind:
        case T.StructType():
            names = [k for k in dict.fromkeys(keys) if k in kind.names] if keys is not None else sorted(kind.names, key=_order)
            parts = [F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), canonical(value[n], kind[n].dataType, keys)) for n in names]
            out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
        case T.MapType(keyType=T.StringType()):
            wanted = F.array(*map(F.lit, dict.fromkeys(keys))) if keys is not None else F.array_sort(F.map_keys(value))
            held = F.filter(wanted, lambda k: F.map_contains_key(value, k)) if keys is not None else wanted
            each = lambda k: F.concat(text(k), F.lit(":"), canonical(value[k], kind.valueType, keys))
            out = F.concat(F.lit("{"), F.array_join(F.transform(held, each), ","), F.lit("}"))
        case T.ArrayType():
            out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType, keys)), ","), F.lit("]"))
        case T.StringType():
            out = text(value)
        case T.BooleanType() | T.IntegralType():
            out = value.cast("string")
        case T.FractionalType():
            return number(value.cast("double"))
        case T.NullType():
            return F.lit("null")
        case _:
            out = text(value.cast("string"))
    return F.coalesce(F.when(value.isNotNull(), out), F.lit("null"))


def script_number(x: float | int) -> str:
    """A number as JavaScript writes it; integers beyond 2**53 stay whole."""
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    mantissa, _, power = f"{x!r}".lower().partition("e")
    sign, mantissa = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
    whole, _, part = mantissa.partition(".")
    digits, at = whole + part, len(whole) + int(power or 0)
    at -= len(digits) - len(digits.lstrip("0"))
    d = digits.strip("0")
    if at > 21 or at < -5:
        return f"{sign}{d[0]}{'.' + d[1:] if len(d) > 1 else ''}e{at - 1:+d}"
    if at >= len(d):
        return sign + d.ljust(at, "0")
    return sign + (d[:at] + "." + d[at:] if at > 0 else "0." + "0" * -at + d)


def plain(value: Any, sort: bool = True, keys: Sequence[str] | None = None) -> str:
    """JSON of a parsed value."""
    match value:
        case dict():
            names = [k for k in dict.fromkeys(keys) if k in value] if keys is not None else sorted(value, key=_order) if sort else list(value)
            return "{" + ",".join(f"{json.dumps(n, ensure_ascii=False)}:{plain(value[n], sort, keys)}" for n in names) + "}"
        case list():
            return "[" + ",".join(plain(v, sort, keys) for v in value) + "]"
        case bool() | None | str():
            return json.dumps(value, ensure_ascii=False)
    return script_number(value)


def rewritten(sort: bool = True, keys: Sequence[str] | None = None, spaced: bool = False):
    """A function of a JSON text column: the canonical text, null for what is no JSON.

    ``spaced`` writes sorted keys the way Python's ``json.dumps`` does, with a space
    after each comma and colon and all but ASCII escaped.
    """
    wanted = None if keys is None else list(keys)

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                value = json.loads(t) if t is not None else None
            except ValueError:
                return None
            return None if t is None else json.dumps(value, sort_keys=True) if spaced else plain(value, sort, wanted)

        return texts.map(one)

    return rewrite
