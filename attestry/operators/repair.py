"""Numbers that were misread: letters for digits, a digit too many or too few.

``corrected`` follows the rules by kind of number (Egyptian IDs, IBANs, passports),
within one row and with built-in functions.  ``by_check_digit`` finds the cheapest
reading of a number whose check digit is a weighted sum: a table of the best cost for
each remainder, position by position, so that it looks at all combinations of
look-alikes without listing them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from attestry.functions.numbers import bound

#: Letters that stand for digits in IBANs and passports.
LETTERS, DIGITS = "OoDQIil|SsBZGAgq", "0000111155826499"

#: What may be read for a digit, and at which cost; a digit for itself costs nothing.
LOOKALIKES: dict[str, dict[str, int]] = {
    "0": {"O": 1, "o": 1, "D": 1, "Q": 1, "8": 3, "6": 3},
    "1": {"I": 1, "i": 1, "l": 1, "|": 1, "7": 2, "4": 3},
    "2": {"Z": 1, "z": 1, "7": 3},
    "3": {"8": 2, "9": 3},
    "4": {"A": 1, "9": 2, "1": 3},
    "5": {"S": 1, "s": 1, "6": 2},
    "6": {"G": 1, "b": 1, "5": 2, "8": 2, "0": 3},
    "7": {"T": 2, "1": 2, "2": 3},
    "8": {"B": 1, "3": 2, "6": 2, "0": 3},
    "9": {"g": 1, "q": 1, "4": 2, "3": 3},
}


def bare(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\-./ ]", "")


def egyptian_shape(s: Column) -> Column:
    """Century, month, day and governorate of fourteen digits."""
    part = lambda at, n: F.substring(s, at, n).cast("int")
    return F.when(s.rlike(r"^[23]\d{13}$"), part(4, 2).between(1, 12) & part(6, 2).between(1, 31) & part(8, 2).between(1, 88)).otherwise(F.lit(False))


def egyptian_check(s: Column) -> Column:
    total = F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.lit(0), lambda t, i: t + s.substr(i, F.lit(1)).cast("int") * i) % 11
    last = F.substring(s, 14, 1).cast("int")
    return F.when(s.rlike(r"^\d{14}$"), bound(total, lambda t: ((11 - t) % 11 == last) | (t == last))).otherwise(F.lit(False))


def _egyptian(s: Column) -> Column:
    """Of thirteen or fifteen digits the first candidate that has shape and check,
    else the first that has the shape, else the number as it is."""
    cut = lambda i: F.concat(s.substr(F.lit(1), i), s.substr(i + 2, F.lit(20)))
    put = lambda d: F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.concat(s.substr(F.lit(1), i), d, s.substr(i + 1, F.lit(20))))
    longer = F.flatten(F.transform(F.array(*[F.lit(str(d)) for d in range(10)]), put))
    shorter = F.transform(F.sequence(F.lit(0), F.lit(14)), cut)
    shaped = F.filter(F.when(F.length(s) == 13, longer).otherwise(shorter), egyptian_shape)
    return bound(shaped, lambda c: F.coalesce(F.get(F.filter(c, egyptian_check), F.lit(0)), F.get(c, F.lit(0)), s))


def _iban(s: Column) -> Column:
    check = F.translate(F.substring(s, 3, 2), LETTERS, DIGITS)
    return F.when(check.rlike(r"^\d{2}$"), F.concat(F.substring(s, 1, 2), check, s.substr(F.lit(5), F.lit(40)))).otherwise(s)


def _passport(s: Column) -> Column:
    front = F.regexp_extract(s, "^[A-Z]{0,2}", 0)
    return F.concat(front, F.translate(s.substr(F.length(front) + 1, F.lit(20)), LETTERS, DIGITS))


def corrected(number: Column, country: Column) -> Column:
    """The number without blanks, dashes, dots and slashes, put right by its kind; null and empty stay."""
    egypt = F.coalesce(F.lower(country) == "eg", F.lit(False))

    def kinds(s: Column) -> Column:
        n = F.length(s)
        other = (
            F.when(s.rlike(r"^[A-Z]{2}.{20,32}$"), _iban(s))
            .when(s.rlike(r"^[A-Za-z0-9]{8,9}$"), _passport(F.upper(s)))
            .otherwise(s)
        )
        return F.when(egypt & s.rlike(r"^\d{14}$"), s).when(egypt & s.rlike(r"^(\d{13}|\d{15})$") & (n != 14), _egyptian(s)).otherwise(other)

    return F.when(number.isNull() | (number == ""), number).otherwise(bound(bare(number), kinds))


def iban_valid(text: Column) -> Column:
    """ISO 13616: the first four characters moved to the end, letters as 10 to 35, leave 1 after division by 97."""

    def rest(s: Column) -> Column:
        turned = F.concat(s.substr(F.lit(5), F.lit(40)), F.substring(s, 1, 4))
        value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        step = lambda t, i: bound(value(turned.substr(i, F.lit(1))), lambda v: (t * F.when(v > 9, 100).otherwise(10) + v) % 97)
        return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), step) == 1

    return bound(F.upper(bare(F.coalesce(text, F.lit("")))), lambda s: F.when(s.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$"), rest(s)).otherwise(F.lit(False)))


def weighted(weights: Sequence[int], modulus: int) -> list[list[int]]:
    """What each digit adds at each place: digit times weight."""
    return [[w * d % modulus for d in range(10)] for w in weights]


def luhn(size: int) -> list[list[int]]:
    """The same for Luhn's sum of ``size`` digits."""
    return [[(2 * d - 9 * (d > 4)) if (size - i) % 2 == 0 else d for d in range(10)] for i in range(size)]


def _costs(lookalikes: Mapping[str, Mapping[str, int]]) -> np.ndarray:
    out = np.full((128, 10), np.inf)
    for d in range(10):
        out[48 + d, d] = 0
        for c, cost in lookalikes[str(d)].items():
            out[ord(c), d] = min(out[ord(c), d], cost)
    return out


def cheapest(texts: Sequence[str | None], adds: Sequence[Sequence[int]], modulus: int, wanted: Sequence[int], lookalikes: Mapping[str, Mapping[str, int]] = LOOKALIKES) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Best reading, its cost, and how many readings cost as little."""
    n, rows = len(adds), len(texts)
    wide = np.array([t if t is not None and len(t) == n else "\0" * n for t in texts], f"U{n}")
    points = np.zeros((rows, n), np.uint32)
    raw = wide.view(np.uint32).reshape(rows, n) if rows else points
    points[:] = np.where(raw < 128, raw, 0)
    price = _costs(lookalikes)[points]  # rows, places, digits
    best = np.full((rows, modulus), np.inf)
    best[:, 0] = 0
    ways = np.zeros((rows, modulus))
    ways[:, 0] = 1
    taken = np.zeros((n, rows, modulus), np.int8)
    for i in range(n):
        new, count = np.full_like(best, np.inf), np.zeros_like(ways)
        for d in range(10):
            moved, many = np.roll(best, adds[i][d] % modulus, axis=1) + price[:, i, d, None], np.roll(ways, adds[i][d] % modulus, axis=1)
            less, same = moved < new, (moved == new) & np.isfinite(moved)
            count = np.where(less, many, count + np.where(same, many, 0))
            taken[i][less] = d
            new = np.where(less, moved, new)
        best, ways = new, count
    ends = best[:, list(wanted)]
    cost = ends.min(axis=1) if rows else np.zeros(0)
    which = np.array(list(wanted))[ends.argmin(axis=1)] if rows else np.zeros(0, int)
    total = np.where(ends == cost[:, None], ways[:, list(wanted)], 0).sum(axis=1) if rows else np.zeros(0)
    digits, at, each = np.zeros((n, rows), np.int8), which.copy(), np.arange(rows)
    for i in range(n - 1, -1, -1):
        digits[i] = taken[i][each, at]
        at = (at - np.array(adds[i])[digits[i]]) % modulus
    found = np.isfinite(cost)
    return ["".join(map(str, digits[:, r])) if found[r] else None for r in range(rows)], cost, total


def by_check_digit(df: DataFrame, key: str, number: str, adds: Sequence[Sequence[int]], modulus: int, wanted: Sequence[int] = (0,), lookalikes: Mapping[str, Mapping[str, int]] = LOOKALIKES) -> DataFrame:
    """``key``, ``repaired``, ``cost`` and ``ways`` of each row.

    ``adds`` has for each place what each digit adds to the sum, whose remainder must be
    one of ``wanted``.  A number of another length, or without any such reading, is
    null; with more than one ``way`` the reading is one of several that cost the same.
    """
    kind = df.schema[key].dataType
    rows = [[int(x) % modulus for x in line] for line in adds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read, cost, ways = cheapest(batch.column(1).to_pylist(), rows, modulus, wanted, lookalikes)
            some = np.isfinite(cost)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(to_arrow_type(kind)), pa.array(read, pa.string()), pa.array(np.where(some, cost, 0).astype(np.int64), mask=~some), pa.array(np.where(some, ways, 0).astype(np.int64))], [key, "repaired", "cost", "ways"])

    return df.select(key, bare(F.col(number)).alias(number)).mapInArrow(run, f"`{key}` {kind.simpleString()}, repaired string, cost long, ways long")
