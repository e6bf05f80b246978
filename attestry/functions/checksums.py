"""National-ID rules as one declarative table, evaluated inside Catalyst.

A rule names how an ID is cleaned, the shape that makes it valid, the checksum
and what it decodes.  Everything compiles to arithmetic on characters, so a
column of IDs is checked within whole-stage code generation, without UDFs.  The
same expressions are plain SQL, apart from the names of a few functions.

Some rules don't follow the issuing authority's published algorithm (their
``conforms`` is false); they are kept as the engine's users know them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions.numbers import bound

BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Verhoeff multiplication and permutation tables.
VERHOEFF_D = (
    "0123456789",
    "1234067895",
    "2340178956",
    "3401289567",
    "4012395678",
    "5987604321",
    "6598710432",
    "7659821043",
    "8765932104",
    "9876543210",
)
VERHOEFF_P = ("0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258")

#: Values of the first characters in odd places, by digit (fixed values).
_IT_ODD_DIGITS = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21)


def digit(i: int, of: str = "c") -> str:
    return f"(ascii(substr({of}, {i + 1}, 1)) - 48)"


def alnum(i: int, of: str = "c", letters: str = BASE36) -> str:
    return f"(instr('{letters}', substr({of}, {i + 1}, 1)) - 1)"


def number(start: int, size: int, of: str = "c") -> str:
    return f"cast(substr({of}, {start + 1}, {size}) as bigint)"


def weighted(weights, value=digit) -> str:
    return "(" + " + ".join(f"{value(i)} * {w}" for i, w in enumerate(weights)) + ")"


def luhn(n: int, doubled: int) -> str:
    """Digit sum in which places of parity ``doubled`` count twice."""
    twice = lambda i: f"(case when {digit(i)} > 4 then {digit(i)} * 2 - 9 else {digit(i)} * 2 end)"
    return "(" + " + ".join(twice(i) if i % 2 == doubled else digit(i) for i in range(n)) + ")"


def finish(total: str, kind: str, mod: int = 11) -> str:
    """Check value of a weighted sum."""
    r = f"({total} % {mod})"
    return {
        "rest": r,
        "less": f"({mod} - {r})",
        "less_or_0": f"(({mod} - {r}) % {mod})",
        "less_mod_10": f"(({mod} - {r}) % 10)",
        "small_stays": f"(case when {r} < 2 then {r} else {mod} - {r} end)",
        "small_is_0": f"(case when {r} < 2 then 0 else {mod} - {r} end)",
        "ten_is_0": f"(case when {r} = 10 then 0 else {r} end)",
        "ten_is_1": f"(case when {r} = 10 then 1 else {r} end)",
    }[kind]


def _check(weights, kind: str, mod: int = 11, value=digit) -> str:
    return f"{finish(weighted(weights, value), kind, mod)} = {value(len(weights))}"


def _down(start: int, stop: int = 2) -> list[int]:
    return list(range(start, stop - 1, -1))


@dataclass(frozen=True)
class Rule:
    """``clean``: digits, alnum, spaces or a pattern of characters to drop (after
    upper-casing); ``shape``: pattern of a valid cleaned ID; ``valid``: further
    condition; ``checksum``: condition; ``year``, ``month``, ``day``, ``male``:
    decoded parts."""

    clean: str
    shape: str
    checksum: str = "true"
    valid: str = "true"
    year: str | None = None
    month: str | None = None
    day: str | None = None
    male: str | None = None
    conforms: bool = True
    notes: str = field(default="", compare=False)


def _d(n: int | str, checksum: str = "true", **more) -> Rule:
    return Rule("digits", f"^[0-9]{{{n}}}$", checksum, **more)


_N = number
_CYCLE_7 = [7, 6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]
_CYCLE_10 = [2, 3, 4, 5, 6, 7, 8, 9, 10, 2, 3]
_BALTIC = ([1, 2, 3, 4, 5, 6, 7, 8, 9, 1], [3, 4, 5, 6, 7, 8, 9, 1, 2, 3])
_BALTIC_CHECK = f"(case when {weighted(_BALTIC[0])} % 11 = 10 then {finish(weighted(_BALTIC[1]), 'ten_is_0')} else {weighted(_BALTIC[0])} % 11 end) = {digit(10)}"


def _verhoeff(n: int) -> str:
    step = "0"
    for i in range(n):
        row = "||".join(f"'{p}'" for p in VERHOEFF_P)
        perm = f"cast(substr({row}, {(i % 8) * 10} + {digit(n - 1 - i)} + 1, 1) as int)"
        step = f"cast(substr('{''.join(VERHOEFF_D)}', ({step}) * 10 + {perm} + 1, 1) as int)"
    return f"{step} = 0"


def _iso_11_10(n: int) -> str:
    p = "10"
    for i in range(n):
        # (s + 9) % 10 + 1 turns a 0 into 10
        p = f"(((({p} + {digit(i)} + 9) % 10 + 1) * 2) % 11)"
    return f"(11 - {p}) % 10 = {digit(n)}"


def _it_odd(i: int) -> str:
    arms = " ".join(f"when '{d}' then {v}" for d, v in enumerate(_IT_ODD_DIGITS))
    return f"(case substr(c, {i + 1}, 1) {arms} else greatest(ascii(substr(c, {i + 1}, 1)) - 65, 0) end)"


def _it_even(i: int) -> str:
    ch = f"substr(c, {i + 1}, 1)"
    return f"(case when {ch} between '0' and '9' then {digit(i)} else greatest(ascii({ch}) - 65, 0) end)"


def _chile() -> str:
    # The body's last digit weighs 2, and weights run 2..7 towards the front.
    arms = []
    for n in (7, 8, 9):
        total = " + ".join(f"{digit(i)} * {2 + (n - 1 - i) % 6}" for i in range(n))
        r = f"(({total}) % 11)"
        arms.append(f"when {n + 1} then (case {r} when 0 then '0' when 1 then 'K' else cast(11 - {r} as varchar(2)) end) = substr(c, {n + 1}, 1)")
    return f"(case length(c) {' '.join(arms)} end)"


def _hong_kong() -> str:
    # Nine places; a blank before a single letter and behind the digits counts as -23.
    arms = []
    for letters in (1, 2):
        body = letters + 6
        values = ["(-23)", *["(-23) * 9"] * (letters == 1), *[f"{alnum(i)} * {9 - i - (2 - letters)}" for i in range(body)]]
        r = f"((({' + '.join(values)}) % 11 + 0))"
        arms.append(f"when {body + 1} then (case {r} when 0 then '0' when 1 then 'A' else cast(11 - {r} as varchar(3)) end) = substr(c, {body + 1}, 1)")
    return f"(case length(c) {' '.join(arms)} end)"


def _finland() -> str:
    letters = "0123456789ABCDEFHJKLMNPRSTUVWXY"
    mark = f"(case when {alnum(6)} > 9 then cast({alnum(6)} as varchar(2)) else substr(c, 7, 1) end)"
    return f"substr('{letters}', cast(cast(substr(c, 1, 6) || {mark} || substr(c, 8, 3) as bigint) % 31 as int) + 1, 1) = substr(c, 11, 1)"


_ES_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_TR_ODD = " + ".join(digit(i) for i in (0, 2, 4, 6, 8))
_TR_EVEN = " + ".join(digit(i) for i in (1, 3, 5, 7))

#: One rule for each country.
RULES: dict[str, Rule] = {
    "EG": _d(
        14,
        f"({finish(weighted(range(1, 14)), 'less_or_0')} = {digit(13)} or {weighted(range(1, 14))} % 11 = {digit(13)})",
        valid=f"{digit(0)} between 2 and 4 and {_N(3, 2)} between 1 and 12 and {_N(5, 2)} between 1 and 31",
        year=f"1700 + 100 * {digit(0)} + {_N(1, 2)}",
        month=_N(3, 2),
        day=_N(5, 2),
        male=f"{_N(7, 4)} % 2 = 1",
    ),
    "SA": _d(10, f"{luhn(10, 0)} % 10 = 0", year=f"{_N(0, 2)} + 778", month=_N(2, 2), day=_N(4, 2), male=f"{digit(6)} % 2 = 1", conforms=False),
    "AE": Rule("digits", "^784[0-9]{12}$", f"{weighted([2 ** (14 - i) for i in range(15)])} % 11 = 1", conforms=False),
    "IL": _d(9, f"{luhn(9, 1)} % 10 = 0"),
    "TR": _d(11, f"((({_TR_ODD}) * 7 - {digit(8)}) % 10 = {digit(9)} and ({_TR_ODD} + {_TR_EVEN} + {digit(9)}) % 10 = {digit(10)})", valid=f"{digit(0)} <> 0", conforms=False),
    "FR": _d(15, f"97 - {_N(0, 13)} % 97 = {_N(13, 2)}", year=f"1900 + {_N(1, 2)}", month=_N(3, 2), day=_N(5, 2), male=f"case {digit(0)} when 1 then true when 2 then false end"),
    "ES": Rule("spaces", "^([0-9]{8}|[XYZ][0-9]{7})[A-Z]$", f"substr('{_ES_LETTERS}', cast(cast(translate(substr(c, 1, 8), 'XYZ', '012') as bigint) % 23 as int) + 1, 1) = substr(c, 9, 1)"),
    "PT": _d(9, _check(_down(9), "less")),
    "BR": _d(11, f"{_check(_down(10), 'small_is_0')} and {_check(_down(11), 'small_is_0')}", valid="c <> repeat(substr(c, 1, 1), 11)"),
    "DE": Rule("alnum", "^[A-Z0-9]{11}$", f"{weighted([(7, 3, 1)[i % 3] for i in range(11)], alnum)} % 10 = 0"),
    "IT": Rule("spaces", "^.{16}$", "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast((" + " + ".join(_it_odd(i) if i % 2 == 0 else _it_even(i) for i in range(15)) + ") % 26 as int) + 1, 1) = substr(c, 16, 1)", conforms=False),
    "NL": _d(9, f"({weighted(_down(9))} - {digit(8)}) % 11 = 0"),
    "BE": _d(
        11,
        f"({_N(9, 2)} = 97 - cast(cast({_N(0, 2)} as varchar(2)) || substr(c, 3, 4) || cast({_N(6, 3)} as varchar(3)) as bigint) % 97 or {_N(9, 2)} = 97 - (cast(cast({_N(0, 2)} as varchar(2)) || substr(c, 3, 4) || cast({_N(6, 3)} as varchar(3)) as bigint) + 2000000) % 97)",
        year=f"1900 + {_N(0, 2)}",
        month=_N(2, 2),
        day=_N(4, 2),
        conforms=False,
    ),
    "SE": _d("10}$|^[0-9]{12", f"{luhn(10, 0).replace('(c,', '(substr(c, length(c) - 9, 10),')} % 10 = 0"),
    "NO": _d(11, f"{_check([3, 7, 6, 1, 8, 9, 4, 5, 2], 'less')} and {_check([5, 4, 3, 2, 7, 6, 5, 4, 3, 2], 'less')}", year=f"case when {_N(6, 3)} >= 500 then 1900 else 2000 end + {_N(4, 2)}", month=_N(2, 2), day=_N(0, 2), male=f"{_N(6, 3)} % 2 = 1"),
    "US": _d(9, valid=f"{_N(0, 3)} between 1 and 899 and {_N(0, 3)} <> 666 and {_N(3, 2)} > 0 and {_N(5, 4)} > 0"),
    "GB": Rule("spaces", "^[A-CEGHJ-PR-TW-Z]{2}[0-9]{6}[A-D]$"),
    "IN": _d(12, _verhoeff(12), valid=f"{digit(0)} > 1"),
    "ZA": _d(13, f"{luhn(13, 1)} % 10 = 0", year=f"1900 + {_N(0, 2)}", month=_N(2, 2), day=_N(4, 2), male=f"{digit(6)} >= 5"),
    "MX": Rule("alnum", "^[A-Z0-9]{18}$", f"{weighted(_down(18), alnum)} % 10 = {alnum(17)}", conforms=False),
    "PK": _d(13),
    "PL": _d(
        11,
        f"{finish(weighted([1, 3, 7, 9, 1, 3, 7, 9, 1, 3]), 'less_or_0', 10)} = {digit(10)}",
        year=f"case when {_N(2, 2)} > 80 then 1800 when {_N(2, 2)} > 60 then 2200 when {_N(2, 2)} > 40 then 2100 when {_N(2, 2)} > 20 then 2000 else 1900 end + {_N(0, 2)}",
        month=f"case when {_N(2, 2)} > 20 then ({_N(2, 2)} - 1) % 20 + 1 else {_N(2, 2)} end",
        day=_N(4, 2),
        male=f"{_N(6, 4)} % 2 = 1",
    ),
    "CZ": _d("9,10", f"(case when length(c) = 10 then {_N(0, 9)} % 11 = {digit(9)} else true end)", year=f"case when {_N(0, 2)} >= 54 then 1900 else 2000 end + {_N(0, 2)}", month=f"case when {_N(2, 2)} > 50 then {_N(2, 2)} - 50 else {_N(2, 2)} end", day=_N(4, 2), male=f"{_N(2, 2)} <= 50"),
    "GR": Rule("alnum", "^[A-Z]{2}[0-9]{6}$"),
    "RO": _d(13, _check([2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9], "ten_is_1"), year=f"case when {digit(0)} <= 2 then 1900 when {digit(0)} <= 4 then 1800 when {digit(0)} <= 6 then 2000 else 1900 end + {_N(1, 2)}", month=_N(3, 2), day=_N(5, 2), male=f"case when {digit(0)} between 1 and 8 then {digit(0)} % 2 = 1 end"),
    "IE": Rule("alnum", "^[0-9]{7}[A-Z]{1,2}$", f"substr('WPCAPGQWWWWWWWWWWWWWWWW', {weighted(_down(8))} % 23 + 1, 1) = substr(c, 8, 1)", conforms=False),
    "DK": _d(10, year=f"case when {_N(6, 4)} >= 4000 then 1900 when {_N(6, 4)} >= 2000 then 1800 else 2000 end + {_N(4, 2)}", month=_N(2, 2), day=_N(0, 2), male=f"{_N(6, 4)} % 2 = 1"),
    "FI": Rule("alnum", "^[0-9]{6}[A-Z0-9][0-9]{3}[A-Z0-9]$", _finland(), year=f"case when substr(c, 7, 1) between 'A' and 'F' then 2000 else 1900 end + {_N(4, 2)}", month=_N(2, 2), day=_N(0, 2), male=f"{_N(7, 3)} % 2 = 1", conforms=False),
    "HR": _d(11, _iso_11_10(10)),
    "RS": _d(13, _check(_CYCLE_7, "less_or_0"), year=_N(4, 3), month=_N(2, 2), day=_N(0, 2), male=f"{_N(7, 3)} % 2 = 1", conforms=False),
    "BG": _d(10, _check([2, 4, 8, 5, 10, 9, 7, 3, 6], "ten_is_0"), year=f"case when {_N(2, 2)} > 40 then 2000 when {_N(2, 2)} > 20 then 1800 else 1900 end + {_N(0, 2)}", month=f"case when {_N(2, 2)} > 40 then {_N(2, 2)} - 40 when {_N(2, 2)} > 20 then {_N(2, 2)} - 20 else {_N(2, 2)} end", day=_N(4, 2), male=f"{_N(6, 3)} % 2 = 1"),
    "HU": Rule("alnum", "^[A-Z0-9]{11}$", f"{weighted(range(1, 11), alnum)} % 11 = {alnum(10)}"),
    "SK": _d("10,11", f"(case when length(c) = 11 then {_N(0, 10)} % 11 = {digit(10)} else true end)", male=f"{_N(2, 2)} <= 50", conforms=False),
    "EE": _d(11, _BALTIC_CHECK, year=f"case when {digit(0)} <= 2 then 1800 when {digit(0)} <= 4 then 1900 when {digit(0)} <= 6 then 2000 else 1900 end + {_N(1, 2)}", month=_N(3, 2), day=_N(5, 2), male=f"{digit(0)} % 2 = 1"),
    "LV": _d("11,12"),
    "LT": _d(11, _BALTIC_CHECK),
    "SI": _d(13, _check(_CYCLE_7, "less_or_0")),
    "IS": _d(10, _check([3, 2, 7, 6, 5, 4, 3, 2, 1], "less"), year=f"1900 + {_N(4, 2)}", month=_N(2, 2), day=_N(0, 2), conforms=False),
    "RU": _d(
        "10}$|^[0-9]{12",
        f"(case when length(c) = 12 then {_check([7, 2, 4, 10, 3, 5, 9, 4, 6, 8], 'ten_is_0')} and {_check([3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8], 'ten_is_0')} else {_check([2, 4, 10, 3, 5, 9, 4, 6, 8], 'ten_is_0')} end)",
    ),
    "CH": _d("11}$|^[0-9]{13", f"(case when length(c) = 13 then {luhn(13, 1)} else {luhn(11, 1)} end) % 10 = 0", conforms=False),
    "AT": _d("8,9"),
    "AR": _d("7,8"),
    "CL": Rule("[^0-9K]", "^[0-9]{7,9}[0-9K]$", _chile()),
    "CO": _d("8,11"),
    "AU": _d("9}$|^[0-9]{11", f"(case when length(c) = 9 then {weighted([1, 4, 3, 7, 5, 8, 6, 9, 10])} else {weighted([1, 4, 3, 7, 5, 8, 6, 9, 10, 1, 4])} end) % 11 = 0"),
    "CA": _d(9, f"{luhn(9, 1)} % 10 = 0"),
    "JP": _d(12, _check([6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2], "less_or_0")),
    "KR": _d(13, _check([2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5], "less_mod_10"), year=f"case when {digit(6)} <= 2 then 1900 when {digit(6)} <= 4 then 2000 else 1900 end + {_N(0, 2)}", month=_N(2, 2), day=_N(4, 2), male=f"{digit(6)} % 2 = 1"),
    "TH": _d(13, _check(_down(13), "less_mod_10")),
    "ID": _d(16),
    "PH": _d("12,13"),
    "SG": Rule(
        "alnum",
        "^[STFG][0-9]{7}[A-Z]$",
        "substr(case when substr(c, 1, 1) in ('S', 'T') then 'JZIHGFEDCBA' else 'XWUTRQPNMLK' end, (" + " + ".join(f"{digit(i + 1)} * {w}" for i, w in enumerate([2, 7, 6, 5, 4, 3, 2])) + " + case when substr(c, 1, 1) in ('T', 'G') then 4 else 0 end) % 11 + 1, 1) = substr(c, 9, 1)",
    ),
    "MY": _d(12, year=f"case when {_N(0, 2)} >= 30 then 1900 else 2000 end + {_N(0, 2)}", month=_N(2, 2), day=_N(4, 2), male=f"{_N(8, 4)} % 2 = 1"),
    "HK": Rule("alnum", "^[A-Z]{1,2}[0-9]{6}[A-Z0-9]$", _hong_kong(), conforms=False),
    "VN": _d(12, f"(10 - {weighted([3, 7, 9, 1, 4, 6, 10, 5, 8, 2, 3])} % 11) % 10 = {digit(11)}", year=f"case when {digit(3)} in (2, 3) then 2000 when {digit(3)} in (4, 5) then 2100 else 1900 end + {_N(4, 2)}", month=_N(6, 2), day=_N(8, 2), male=f"{digit(3)} not in (1, 3, 5)", conforms=False),
    "BD": _d("10}$|^[0-9]{13}$|^[0-9]{17", f"(case when length(c) = 10 then {luhn(10, 0)} % 10 = 0 else true end)"),
    "LK": Rule("[^0-9VX]", "^([0-9]{9}[VX]|[0-9]{12})$", f"(case when length(c) = 12 then {finish(weighted([8, 4, 3, 2, 7, 6, 5, 1, 8, 4, 3]), 'less_or_0')} = {digit(11)} else true end)", year=f"case when length(c) = 12 then {_N(0, 4)} else 1900 + {_N(0, 2)} end", month=f"case when length(c) = 12 then {_N(4, 2)} else {_N(2, 2)} end", day=f"case when length(c) = 12 then {_N(6, 2)} else {_N(4, 2)} end", male="case when length(c) = 10 then true end", conforms=False),
    "NP": _d(11, _check(_down(11), "less_or_0")),
    "AF": _d(10, _check(_down(10), "small_stays")),
    "IR": _d(10, _check(_down(10), "small_stays"), valid="c <> repeat(substr(c, 1, 1), 10)"),
    "IQ": _d(12, _check(_CYCLE_10, "rest")),
    "LB": _d(12, _check([7, 6, 5, 4, 3, 2, 7, 6, 5, 4, 3], "rest")),
    "PS": _d(9, f"{luhn(9, 1)} % 10 = 0"),
    "SD": _d(11, _check(_down(11), "small_stays")),
    "LY": _d(12, _check(_CYCLE_10, "rest")),
    "YE": _d(10, _check(_down(10), "small_stays")),
    "MU": Rule("alnum", "^[A-Z][A-Z0-9]{13}$", f"{weighted(_down(14), alnum)} % 23 = {alnum(13)} % 23"),
    "DZ": _d(18, f"({weighted(_down(18))} % 23 = {digit(17)} or {weighted(_down(18))} % 23 % 10 = {digit(17)})"),
    "TN": _d(8, f"({weighted(_down(8))} % 29 = {digit(7)} or {weighted(_down(8))} % 29 % 10 = {digit(7)})"),
    "GH": Rule("alnum", "^[A-Z0-9]{12}$", f"{weighted(_down(12), lambda i: alnum(i, letters='0123456789ABCDEFGHJKLMNPRSTUVWXYZ'))} % 31 = {alnum(11, letters='0123456789ABCDEFGHJKLMNPRSTUVWXYZ')}", conforms=False),
    "BH": _d(9, f"{luhn(9, 1)} % 10 = 0"),
    "KW": _d(12, _check(_CYCLE_10, "rest"), year=f"2000 + {_N(0, 2)}", month=_N(2, 2), day=_N(4, 2), conforms=False),
    "MA": _d(18, _check(_down(18), "small_stays")),
    "NG": _d(11, _check(_down(11), "small_stays")),
    "KH": _d(9),
}


def supported_countries() -> list[str]:
    return sorted(RULES)


def cleaned_sql(rule: Rule, raw: str, duckdb: bool = False) -> str:
    flags = ", 'g'" if duckdb else ""
    text = f"coalesce({raw}, '')"
    if rule.clean == "digits":
        return f"regexp_replace({text}, '[^0-9]', ''{flags})"
    drop = {"alnum": "[^A-Z0-9]", "spaces": r"[\s]" if duckdb else r"[\\s]"}.get(rule.clean, rule.clean)
    return f"regexp_replace(upper({text}), '{drop}', ''{flags})"


def _named(sql: str, name: str) -> str:
    return sql.replace("(c,", f"({name},").replace("(c)", f"({name})").replace("c <> ", f"{name} <> ")


def rule_sql(country: str, name: str, duckdb: bool = False) -> dict[str, str]:
    """SQL over a column of cleaned IDs: valid, checksum, year, month, day, male."""
    rule = RULES[country]
    match = f"regexp_matches({name}, '{rule.shape}')" if duckdb else f"{name} rlike '{rule.shape}'"
    # Only what has the right shape is computed with.
    ok = f"(case when {match} then {_named(rule.valid, name)} else false end)"
    out = {"valid": ok, "checksum": f"(case when {ok} then {_named(rule.checksum, name)} else false end)"}
    for part in ("year", "month", "day", "male"):
        sql = getattr(rule, part)
        out[part] = f"(case when {ok} then {_named(sql, name)} end)" if sql else "null"
    return out


FIELDS = ("is_valid", "checksum_valid", "birth_year", "birth_month", "birth_day", "sex")


def judged(country: str, raw: str) -> Column:
    """A struct of FIELDS by one country's rule over the raw column ``raw``.  The
    cleaned ID and its validity are bound once, by lambdas over arrays of one."""
    rule = RULES[country]
    part = lambda sql: f"case when _ok then {_named(sql, '_c')} end" if sql else "null"
    sex = f"case when _ok then case when {_named(rule.male, '_c')} then 'Male' when not {_named(rule.male, '_c')} then 'Female' end end" if rule.male else "null"
    values = ("_ok", f"case when _ok then {_named(rule.checksum, '_c')} else false end", part(rule.year), part(rule.month), part(rule.day), sex)
    kinds = ("boolean", "boolean", "bigint", "bigint", "bigint", "string")
    fields = ", ".join(f"'{n}', cast({v} as {k})" for n, v, k in zip(FIELDS, values, kinds, strict=True))
    ok = f"case when _c rlike '{rule.shape}' then coalesce({_named(rule.valid, '_c')}, false) else false end"
    return F.expr(f"transform(array({cleaned_sql(rule, raw)}), _c -> transform(array({ok}), _ok -> named_struct({fields}))[0])[0]")


def validated(country: str, raw: str) -> dict[str, Column]:
    """Columns of one country's rule over the raw column ``raw``."""
    return {n: judged(country, raw)[n] for n in FIELDS}


def validate(df, country: str = "country", raw: str = "id"):
    """Adds FIELDS by each row's own country.

    One choice of a struct by country, so only the rule that applies is computed,
    once.  An unknown country is neither valid nor decoded.
    """
    code = F.upper(F.col(country))
    arms = [F.when(code == cc, judged(cc, f"`{raw}`")) for cc in RULES]
    none = F.struct(F.lit(False).alias("is_valid"), F.lit(False).alias("checksum_valid"), *[F.lit(None).cast(k).alias(n) for n, k in zip(FIELDS[2:], ("bigint",) * 3 + ("string",), strict=True)])
    got = bound(F.coalesce(*arms, none), lambda x: x)
    field = lambda n: F.coalesce(F.col("_judged")[n], F.lit(False)) if n.endswith("valid") else F.col("_judged")[n]
    return df.withColumn("_judged", got).withColumns({n: field(n) for n in FIELDS}).drop("_judged")
