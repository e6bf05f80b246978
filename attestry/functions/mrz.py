"""Machine-readable zones: check digits, detection and parsing as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions.numbers import bound

VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Lines, length, and (line, from, size) of each part.
LAYOUTS = {
    "TD1": {"lines": 3, "size": 30, "number": (0, 5, 9), "number_check": (0, 14, 1), "birth": (1, 0, 6), "birth_check": (1, 6, 1), "sex": (1, 7, 1), "expiry": (1, 8, 6), "expiry_check": (1, 14, 1), "nationality": (1, 15, 3), "name": (2, 0, 30)},
    "TD2": {"lines": 2, "size": 36, "number": (1, 0, 9), "number_check": (1, 9, 1), "nationality": (1, 10, 3), "birth": (1, 13, 6), "birth_check": (1, 19, 1), "sex": (1, 20, 1), "expiry": (1, 21, 6), "expiry_check": (1, 27, 1), "name": (0, 5, 31)},
    "TD3": {"lines": 2, "size": 44, "number": (1, 0, 9), "number_check": (1, 9, 1), "nationality": (1, 10, 3), "birth": (1, 13, 6), "birth_check": (1, 19, 1), "sex": (1, 20, 1), "expiry": (1, 21, 6), "expiry_check": (1, 27, 1), "name": (0, 5, 39)},
}

#: Parts that the composite digit covers, and its place; ``plain`` is the
#: engine's customary reading, ``icao`` the published one.
COMPOSITES = {
    ("TD1", "plain"): (((0, 5, 25), (1, 0, 7), (1, 8, 7), (1, 15, 14)), (1, 29, 1)),
    ("TD2", "plain"): (((1, 0, 10), (1, 13, 7), (1, 21, 7), (1, 28, 7)), (1, 35, 1)),
    ("TD3", "plain"): (((1, 0, 10), (1, 13, 7), (1, 20, 22)), (1, 42, 1)),
    ("TD1", "icao"): (((0, 5, 25), (1, 0, 7), (1, 8, 7), (1, 18, 11)), (1, 29, 1)),
    ("TD2", "icao"): (((1, 0, 10), (1, 13, 7), (1, 21, 14)), (1, 35, 1)),
    ("TD3", "icao"): (((1, 0, 10), (1, 13, 7), (1, 21, 22)), (1, 43, 1)),
}


def check_digit(text: Column) -> Column:
    """Weights 7, 3, 1; digits are themselves, letters 10 to 35, fillers 0."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    value = lambda c: F.greatest(F.instr(F.lit(VALUES), c) - 1, F.lit(0))
    weight = lambda i: F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (i % 3 + 1).cast("int"))
    return F.aggregate(F.transform(chars, lambda c, i: value(c) * weight(i)), F.lit(0), lambda s, v: s + v) % 10


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 25)


def _kind(found: Column) -> Column:
    fits = lambda n, lo, hi: (F.size(found) == n) & F.forall(found, lambda x: F.length(x).between(lo, hi))
    return F.when(fits(3, 28, 30), "TD1").when(fits(2, 34, 36), "TD2").when(fits(2, 42, 44), "TD3")


def detect(text: Column) -> Column:
    return bound(lines(text), _kind)


def _iso(yymmdd: Column, pivot: int) -> Column:
    yy, mm, dd = (F.substring(yymmdd, i, 2).try_cast("int") for i in (1, 3, 5))
    good = yymmdd.rlike("^[0-9]{6}$") & mm.between(1, 12) & dd.between(1, 31)
    return F.when(good, F.format_string("%04d-%02d-%02d", yy + F.when(yy > pivot, 1900).otherwise(2000), mm, dd))


def parse(text: Column, reading: str = "plain", pivot: int = 30) -> Column:
    """A struct of the zone's fields and its four check results; null if the text
    is no zone.  The text is split once, and its lines are padded once."""

    def of(name: str, found: Column) -> Column:
        layout = LAYOUTS[name]
        lined = F.array(*[F.rpad(F.element_at(found, i + 1), layout["size"], "<") for i in range(layout["lines"])])
        return bound(lined, lambda rows: fields(name, layout, [rows[i] for i in range(layout["lines"])]))

    def fields(name: str, layout: dict, padded: list[Column]) -> Column:
        cut = lambda part: F.substring(padded[part[0]], part[1] + 1, part[2])
        get = lambda part: cut(layout[part])
        plain = lambda c: F.trim(F.regexp_replace(c, "<+", " "))
        covered, place = COMPOSITES[name, reading]
        ok = lambda c, d: F.coalesce(check_digit(c) == d.try_cast("int"), F.lit(False))
        number_ok, birth_ok, expiry_ok = (ok(get(p), get(f"{p}_check")) for p in ("number", "birth", "expiry"))
        composite_ok = ok(F.concat(*[cut(p) for p in covered]), cut(place))
        names = F.split(get("name"), "<<", 2)
        return F.struct(
            F.lit(name).alias("format"),
            F.regexp_replace(F.substring(padded[0], 1, 2), "<", "").alias("document_code"),
            F.substring(padded[0], 3, 3).alias("issuer"),
            plain(get("number")).alias("number"),
            get("nationality").alias("nationality"),
            _iso(get("birth"), pivot).alias("birth_date"),
            F.when(get("sex") == "M", "Male").when(get("sex") == "F", "Female").alias("sex"),
            _iso(get("expiry"), 99).alias("expiry_date"),
            plain(F.element_at(names, 1)).alias("surname"),
            plain(F.coalesce(F.try_element_at(names, F.lit(2)), F.lit(""))).alias("given"),
            number_ok.alias("number_ok"),
            birth_ok.alias("birth_ok"),
            expiry_ok.alias("expiry_ok"),
            composite_ok.alias("composite_ok"),
            (number_ok & birth_ok & expiry_ok & composite_ok).alias("valid"),
        )

    def either(found: Column) -> Column:
        return bound(_kind(found), lambda kind: F.when(kind == "TD1", of("TD1", found)).when(kind == "TD2", of("TD2", found)).when(kind == "TD3", of("TD3", found)))

    return bound(lines(text), either)
