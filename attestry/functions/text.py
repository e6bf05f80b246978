"""Normalisation, comparison and extraction of identity texts, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions.numbers import bound

EASTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
WESTERN_DIGITS = "01234567890123456789"
ALEF_VARIANTS = "آأإٱ"

#: Latin letters for Arabic ones.
TRANSLITERATION = {
    "ء": "a", "آ": "a", "أ": "a", "ؤ": "w", "إ": "a", "ئ": "y", "ا": "a", "ب": "b", "ة": "h", "ت": "t",
    "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "th", "ر": "r", "ز": "z", "س": "s", "ش": "sh",
    "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "ع": "a", "غ": "gh", "ـ": "", "ف": "f", "ق": "q", "ك": "k",
    "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ى": "a", "ي": "y",
}

#: Month names by number.
ARABIC_MONTHS = {1: "يناير", 2: "فبراير", 3: "مارس", 4: "أبريل|ابريل", 5: "مايو", 6: "يونيو", 7: "يوليو|يولية", 8: "أغسطس|اغسطس", 9: "سبتمبر", 10: "أكتوبر|اكتوبر", 11: "نوفمبر", 12: "ديسمبر"}


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _empty_is_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def squeeze(text) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"[\s ]+", " "))


def normalize_arabic(text) -> Column:
    s = F.translate(_col(text), "ـ" + ALEF_VARIANTS + "ى", "ـ" + "ا" * 4 + "ي")
    return _empty_is_null(squeeze(F.regexp_replace(s, "ـ", "")))


def normalize_latin(text) -> Column:
    return _empty_is_null(squeeze(text))


def western_digits(text) -> Column:
    return F.translate(_col(text), EASTERN_DIGITS, WESTERN_DIGITS)


def digits_only(text) -> Column:
    return _empty_is_null(F.regexp_replace(western_digits(text), "[^0-9]", ""))


def canonical(text) -> Column:
    """Comparison key: no marks, no variants, no punctuation, lower case."""
    s = F.regexp_replace(_col(text), "[ً-ْٰـ]", "")
    s = F.translate(s, ALEF_VARIANTS + "ىة" + EASTERN_DIGITS, "ا" * 4 + "يه" + WESTERN_DIGITS)
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", "")


def fuzzy_equal(a, b) -> Column:
    blank = lambda x: F.coalesce(_col(x), F.lit("")) == ""
    return F.when(blank(a) & blank(b), True).when(blank(a) | blank(b), False).otherwise(canonical(a) == canonical(b))


def edit_tolerance(a: Column, b: Column) -> Column:
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n <= 4, 1).when(n <= 10, 2).otherwise(3)


def field_matches(expected, actual) -> Column:
    """Equal, contained or within a few edits; no ground truth passes."""
    e, a = canonical(expected), canonical(actual)
    return (
        F.when(F.coalesce(_col(expected), F.lit("")) == "", True)
        .when(F.coalesce(_col(actual), F.lit("")) == "", False)
        .otherwise((e == a) | F.contains(e, a) | F.contains(a, e) | (F.levenshtein(e, a) <= edit_tolerance(e, a)))
    )


def similarity(a, b) -> Column:
    """1 - edits / length of the longer, without case; 0 with a null."""
    x, y = F.lower(_col(a)), F.lower(_col(b))
    n = F.greatest(F.length(x), F.length(y))
    return F.coalesce(F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / n), F.lit(0.0))


def name_overlap(a, b) -> Column:
    """Share of the shorter name's characters that the longer one has; null if
    either has fewer than three letters."""
    keep = lambda x: F.regexp_replace(F.lower(_col(x)), "[^a-z؀-ۿ]", "")
    x, y = keep(a), keep(b)
    short, long = F.when(F.length(x) < F.length(y), x).otherwise(y), F.when(F.length(x) < F.length(y), y).otherwise(x)
    chars = F.filter(F.split(short, ""), lambda ch: ch != "")
    hits = F.size(F.filter(chars, lambda ch: F.contains(long, ch)))
    return F.when((F.length(x) >= 3) & (F.length(y) >= 3), hits / F.length(short))


def sanitize(text, limit: int = 500) -> Column:
    """No control characters, at most ``limit`` characters, trimmed; '' is null."""
    return _empty_is_null(F.trim(F.substring(F.regexp_replace(_col(text), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", ""), 1, limit)))


def masked(text) -> Column:
    s = _col(text)
    return F.when(F.length(s) <= 8, F.repeat(F.lit("*"), F.length(s))).otherwise(F.concat(F.substring(s, 1, 4), F.lit("****"), F.right(s, F.lit(4))))


def normalize_gender(text) -> Column:
    """Exact words first, then first letters; anything else is null."""
    s = F.lower(F.trim(_col(text)))
    return (
        F.when(s.isin("female", "f", "أنثى", "انثى"), "Female")
        .when(s.isin("male", "m", "ذكر"), "Male")
        .when(s.startswith("f") | s.contains("أنث") | s.contains("انث"), "Female")
        .when(s.startswith("m") | s.startswith("ذ"), "Male")
    )


def normalize_date(text) -> Column:
    """ISO date of ISO, day-first and Arabic month texts; else the text itself."""
    s = F.trim(western_digits(text))
    part = lambda pattern, i: F.regexp_extract(s, pattern, i)
    dmy = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4}|\d{2})$"
    year = F.when(F.length(part(dmy, 3)) == 2, F.concat(F.when(part(dmy, 3).try_cast("int") > 30, "19").otherwise("20"), part(dmy, 3))).otherwise(part(dmy, 3))
    fits = lambda m, d: m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31)
    iso = r"^(\d{4})-(\d{2})-(\d{2})$"
    named = F.coalesce(*[F.when(s.rlike(names), F.lit(f"{m:02d}")) for m, names in ARABIC_MONTHS.items()])
    out = F.when(s.rlike(iso) & fits(part(iso, 2), part(iso, 3)), s)
    out = out.when(s.rlike(dmy) & fits(part(dmy, 2), part(dmy, 1)), F.concat(year, F.lit("-"), F.lpad(part(dmy, 2), 2, "0"), F.lit("-"), F.lpad(part(dmy, 1), 2, "0")))
    out = out.when(named.isNotNull() & s.rlike(r"\d{4}"), F.concat(part(r"(\d{4})", 1), F.lit("-"), named, F.lit("-"), F.lpad(part(r"(\d{1,2})", 1), 2, "0")))
    return out.otherwise(_empty_is_null(s))


def transliterate(text) -> Column:
    """Latin letters for Arabic ones, repeated letters once."""
    s = _col(text)
    for letters in (2, 1, 0):
        for arabic, latin in TRANSLITERATION.items():
            if len(latin) == letters == 2 or len(latin) == letters == 0:
                s = F.replace(s, F.lit(arabic), F.lit(latin))
    single = {a: b for a, b in TRANSLITERATION.items() if len(b) == 1}
    s = F.translate(s, "".join(single), "".join(single.values()))
    return F.trim(F.regexp_replace(s, r"(.)\1+", "$1"))


def has_arabic(text) -> Column:
    return _col(text).rlike("[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]")


def has_latin(text) -> Column:
    return _col(text).rlike("[A-Za-zÀ-ɏ]")


def script(text) -> Column:
    return F.when(has_arabic(text) & has_latin(text), "mixed").when(has_arabic(text), "arabic").when(has_latin(text), "latin").otherwise("none")


def fix_ocr_latin(text) -> Column:
    s = _col(text)
    for wrong, right in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("IJ", "U"), ("ni", "m")):
        s = F.replace(s, F.lit(wrong), F.lit(right))
    return s


def clean_numeric_id(text) -> Column:
    """Digits of an ID read by OCR: look-alike letters become digits."""
    return F.regexp_replace(F.translate(F.upper(western_digits(text)), "ODQI|SBZG", "000115826"), "[^0-9]", "")


#: Affixes that the light stemmer takes off, the first that fits.
ENGLISH_SUFFIXES = ("ing", "edly", "ed", "ly", "es", "s", "ment", "tion", "ness", "ity", "er", "or", "ist")
ARABIC_PREFIXES = ("ال", "و", "ف", "ب", "ل", "ك", "من", "في", "على", "الي", "هذا", "تلك")
ARABIC_SUFFIXES = ("ة", "ه", "ي", "نا", "كم", "هم", "هن", "كان", "ون", "ين", "ات", "ين")


def tokens(text) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(_col(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def stem(word: Column) -> Column:
    """Light stem: of an Arabic word one prefix and one suffix go, of any other
    one suffix, where three letters and more are left.  Words under three letters
    stay."""

    def off(w: Column, affixes: tuple[str, ...], pattern: str) -> Column:
        """The word less its first fitting affix."""
        return F.regexp_replace(w, pattern.replace("AFFIX", "|".join(affixes)), "$1")

    def cut(w: Column) -> Column:
        arabic = off(off(w, ARABIC_PREFIXES, "^(?:AFFIX)(?=.{3})(.*)$"), ARABIC_SUFFIXES, "^(.{3,}?)(?:AFFIX)$")
        out = F.when(F.length(w) < 3, w).when(w.rlike("[\u0600-\u06FF]"), arabic)
        for suffix in ENGLISH_SUFFIXES:
            out = out.when(w.endswith(suffix) & (F.length(w) > len(suffix) + 2), F.left(w, F.length(w) - len(suffix)))
        return out.otherwise(w)

    return bound(F.lower(word), cut)


def strip_tags(html) -> Column:
    s = F.regexp_replace(_col(html), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return squeeze(F.regexp_replace(s, r"(?s)<[^>]*>", " "))


def page_title(html) -> Column:
    return _empty_is_null(squeeze(F.regexp_extract(_col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def page_links(html) -> Column:
    return F.regexp_extract_all(_col(html), F.lit(r"""(?i)<a[^>]*href\s*=\s*["']([^"']*)["']"""), F.lit(1))


def aamva_fields(payload) -> Column:
    """Map of a driving licence's barcode: three-letter codes, last one wins."""
    s = _col(payload)
    lines = F.filter(F.split(s, r"[\r\n]+"), lambda x: x.rlike("^[A-Z]{3}.") & (F.length(x) < 103))
    # Later entries come first; map_from_entries needs each key once.
    firsts = F.aggregate(
        F.reverse(lines),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.left(y, F.lit(3)) == F.left(x, F.lit(3))), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.map_from_entries(F.transform(firsts, lambda x: F.struct(F.left(x, F.lit(3)), F.substring(x, 4, 100))))


def qr_kind(payload) -> Column:
    s = F.trim(_col(payload))
    return (
        F.when(F.try_parse_json(s).isNotNull() & s.rlike(r"^[\[{]"), "json")
        .when(s.rlike("(?i)^https?://"), "url")
        .when(s.rlike(r"^[^=:;\n]+[=:][^;\n]*(?:[;\n]|$)"), "pairs")
        .when(s.rlike("^[A-Za-z0-9+/]{16,}={0,2}$"), "base64")
        .otherwise("text")
    )
