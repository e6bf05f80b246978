"""Many phrases in one pass: labelled fields of a reading, intents of a question.

All phrases are one Aho-Corasick automaton, built once in each worker from a
broadcast list whose size is checked; a text is read once, however many phrases
there are, in Arrow batches.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache, reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from attestry.functions.numbers import bound
from attestry.functions.text import fix_ocr_latin
from attestry.operators.records import corrected_names, without_label

#: Bytes of phrases that are sent to each worker at most.
MOST_BYTES = 8 << 20

#: Labels that precede a field in Arabic and in English readings, in the order they are tried.
FIELD_LABELS = {
    "fullNameAr": (("الاسم رباعي", "الاسم الكامل", "الاسم", "اسم رباعي", "اسم"), ()),
    "fullNameEn": ((), ("Holder's Name", "Full Name", "Given Names", "Surname", "Name")),
    "nationalId": (
        ("الرقم القومي", "الرقم القوم", "الرقم الوطني", "البطاقة الوطنية", "رقم البطاقة", "رقم الهوية", "الهوية", "البطاقة"),
        ("Citizen ID", "Identity Card No.", "Identity Card No", "Identity Card", "Identity Number", "Identity No", "National ID", "ID Number", "ID No", "ID Card No", "Personal ID", "Personal No", "Personal Number", "Personal Identification Number"),
    ),
    "birthDate": (("تاريخ الميلاد", "الميلاد"), ("Date of Birth", "Birth Date", "DOB")),
    "nationality": (("الجنسية",), ("Nationality",)),
    "gender": (("النوع", "الجنس"), ("Sex", "Gender")),
    "birthPlace": (("محل الميلاد", "مكان الميلاد"), ("Place of Birth", "Birth Place")),
    "serialNumber": (("الرقم التسلسلي",), ("Serial Number", "Serial No")),
    "issueDate": (("تاريخ الإصدار", "الإصدار"), ("Date of Issue", "Issue Date")),
    "expiryDate": (("تاريخ الانتهاء", "الانتهاء", "المدة"), ("Date of Expiry", "Date of Expiration", "Expiry Date", "Expiration Date", "Expiry", "Expiration")),
    "issuePlace": (("جهة الإصدار", "مكان الإصدار"), ("Issuing Authority", "Place of Issue", "Authority")),
    "documentNo": (
        ("رقم الجواز", "رقم الوثيقة", "رقم الوثيقة الوطنية", "الوثيقة", "الجواز"),
        ("Passport No.", "Passport No", "Passport Number", "Document No.", "Document No", "Document Number", "Doc No.", "Doc No", "Doc Number", "Passport ID", "Travel Document No"),
    ),
}

#: Labels that a value may start with, in the order they are tried.
VALUE_LABELS = ("الاسم", "الاسم رباعي", "الرقم القومي", "تاريخ الميلاد", "النوع", "الجنسية", "الديانة", "الوظيفة", "العنوان", "الحالة الاجتماعية", "Name", "National ID", "Date of Birth", "Gender", "Nationality", "Expiry", "Document No")

#: Countries by name, in the order that breaks ties.
COUNTRIES_AR = ("مصر", "السعودية", "الإمارات", "الكويت", "قطر", "الأردن", "المغرب", "تونس", "الجزائر", "لبنان", "العراق", "سوريا", "ليبيا", "السودان", "البحرين", "عمان", "اليمن", "فلسطين", "تركيا", "إيران", "الولايات المتحدة", "المملكة المتحدة", "فرنسا", "ألمانيا", "إسبانيا", "إيطاليا", "هولندا", "بلجيكا", "السويد", "النرويج")
COUNTRIES_EN = ("Egypt", "Saudi Arabia", "United Arab Emirates", "Kuwait", "Qatar", "Jordan", "Morocco", "Tunisia", "Algeria", "Lebanon", "Iraq", "Syria", "Libya", "Sudan", "Bahrain", "Oman", "Yemen", "Palestine", "Türkiye", "Iran", "United States", "United Kingdom", "France", "Germany", "Spain", "Italy", "Netherlands", "Belgium", "Sweden", "Norway")

#: What a question is about, by the first line with a phrase in it; all phrases of an inner tuple are needed.
INTENTS: tuple[tuple[str, tuple[str | tuple[str, ...], ...]], ...] = (
    ("liveness", ("liveness", "anti-spoof", "anti spoof", "presentation attack", "pad", "blink", "spoof")),
    ("mrz", ("mrz", "machine readable zone", "machine-readable", "icao 9303", "td1", "td2", "td3", "check digit")),
    ("bias", ("bias", "fairness", "demographic parity", "equal opportunity", "disparate impact", "skin tone", "equalized odds")),
    ("multimodal", ("multimodal", "fusion", "dempster-shafer", "dempster shafer", "modality", "biometric fusion")),
    ("adversarial", ("adversarial", "deepfake", "3d mask", "screen replay", "print attack", "silicone finger", "fgsm", "perturbation")),
    ("identity_graph", ("identity graph", "fraud ring", "impossible travel", "velocity attack", "device reuse", "synthetic identity", "mule")),
    ("continuous", ("continuous", "session", "step-up", "step up", "drift", "reverify")),
    ("security_features", ("security feature", "uv watermark", "hologram", "microprint", "ghost photo", "laser engraving", "kinegram", "thermochromic", "guilloche", "intaglio", ("security", "document"))),
    ("validate", ("validate", "validation", "checksum", "national id format", "id format", "luhn", "verhoeff")),
    ("how_does", ("^how ", " how ", "workflow", "pipeline")),
    ("what_is", ("^what ", "^what's", "^whats")),
)

_BETWEEN = frozenset(" \t\n\r\f\v :：﻿     　" + "".join(map(chr, range(0x2000, 0x200B))))


def folded(text: str) -> str:
    """Lower case, a character for each character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@lru_cache(8)
def _automaton(phrases: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        out.add_word(p, i)
    out.make_automaton()
    return out


def _checked(phrases: Sequence[str]) -> tuple[str, ...]:
    found = tuple(dict.fromkeys(p for p in phrases if p))
    if not found or sum(len(p.encode()) for p in found) > MOST_BYTES:
        raise ValueError(f"phrases must have 1 to {MOST_BYTES} bytes")
    return found


def occurring(text: Column, phrases: Sequence[str]) -> Column:
    """Positions in ``phrases`` of those that occur in the text, in any case, ascending; ``^`` ties one to the start."""
    lines = [p.lower() for p in phrases]
    plain = _checked([p.removeprefix("^") for p in lines])
    places: dict[str, list[tuple[int, bool]]] = {}
    for i, p in enumerate(lines):
        places.setdefault(p.removeprefix("^"), []).append((i, p.startswith("^")))

    @F.pandas_udf("array<int>")
    def find(texts: pd.Series) -> pd.Series:
        machine = _automaton(plain)

        def one(t: str | None) -> list[int]:
            got: set[int] = set()
            for end, k in machine.iter(folded(t)) if t else ():
                for i, tied in places[plain[k]]:
                    if not tied or end == len(plain[k]) - 1:
                        got.add(i)
            return sorted(got)

        return texts.map(one)

    return find(text)


def counted(text: Column, phrases: Sequence[str], most: int) -> Column:
    """How often each phrase stands in the text, places that overlap counted once, up to ``most``."""
    plain = _checked(phrases)
    where = [plain.index(p) for p in phrases]

    @F.pandas_udf("array<bigint>")
    def count(texts: pd.Series) -> pd.Series:
        machine, sizes = _automaton(plain), [len(p) for p in plain]

        def one(t: str | None) -> list[int]:
            n, free = [0] * len(plain), [0] * len(plain)
            for end, k in machine.iter(t) if t else ():
                start = end + 1 - sizes[k]
                if start >= free[k] and n[k] < most:
                    n[k] += 1
                    free[k] = end + 1
            return [n[k] for k in where]

        return texts.map(one)

    return count(text)


def intent(question: Column, intents: Sequence[tuple[str, Sequence[str | tuple[str, ...]]]] = INTENTS, otherwise: str = "default") -> Column:
    """The first intent with a phrase in the question (all phrases of an inner tuple)."""
    flat = list(dict.fromkeys(p for _, each in intents for e in each for p in ((e,) if isinstance(e, str) else e)))
    number = {p: i for i, p in enumerate(flat)}

    def named(hit: Column) -> Column:
        has = lambda e: F.array_contains(hit, number[e]) if isinstance(e, str) else reduce(lambda a, b: a & b, [F.array_contains(hit, number[p]) for p in e])
        out = F
        for name, each in intents:
            out = out.when(reduce(lambda a, b: a | b, [has(e) for e in each]), name)
        return out.otherwise(otherwise)

    return F.element_at(F.transform(F.array(occurring(F.trim(F.coalesce(question, F.lit(""))), flat)), named), 1)


def _after(text: str, seen: str, hits: list[tuple[int, int, int]], starts: list[int], label: int) -> str | None:
    """The value behind the first place of a label that has anything behind it."""
    for start, k, size in hits:
        if k != label:
            continue
        at = end = start + size
        while at < len(text) and text[at] in _BETWEEN:
            at += 1
        while at > end and (at == len(text) or text[at] in "\n\r"):
            at -= 1  # what is left for the value may be a blank
        if at == len(text) or text[at] in "\n\r":
            continue
        stop = min((p for p in (text.find("\n", at), text.find("\r", at)) if p >= 0), default=len(text))
        lead = at
        while lead < stop and text[lead].isspace():
            lead += 1
        n = bisect_left(starts, lead)
        while n < len(hits) and hits[n][0] + hits[n][2] > len(text[:stop].rstrip()):
            n += 1
        if n < len(hits) and hits[n][0] < stop:
            stop = hits[n][0]
        return text[lead:stop].strip() or None
    return None


class Labels:
    """The automata of all labels, as they are and in lower case, and the order to try them in."""

    def __init__(self, labels: Mapping[str, tuple[Sequence[str], Sequence[str]]]):
        everything = _checked([label.strip() for pair in labels.values() for part in pair for label in part if len(label.strip()) > 1])
        self.lists = (everything, _checked([folded(p) for p in everything]))
        self.number = tuple({p: i for i, p in enumerate(part)} for part in self.lists)
        self.plan = [(name, [(label, 0) for label in ar] + [(label, 1) for label in en]) for name, (ar, en) in labels.items()]

    def read(self, *texts: str | None) -> Iterator[tuple[str, str, str]]:
        """Field, value and label of an Arabic and an English reading."""
        found = []
        for side, text in enumerate(texts):
            phrases = self.lists[side]
            seen = (folded(text) if side else text) if text else ""
            hits = sorted((end + 1 - len(phrases[k]), k, len(phrases[k])) for end, k in _automaton(phrases).iter(seen)) if seen else []
            found.append((text or "", seen, hits, [h[0] for h in hits]))
        for field, tried in self.plan:
            for label, side in tried:
                shown = label.strip()
                k = self.number[side].get(folded(shown) if side else shown)
                value = _after(*found[side], k) if k is not None and found[side][2] else None
                if value:
                    yield field, value, label
                    break


@lru_cache(1)
def _standard() -> Labels:
    return Labels(FIELD_LABELS)


def fields_of(arabic: str | None, english: str | None) -> Iterator[tuple[str, str, str]]:
    """Field, value and label of one reading, by ``FIELD_LABELS``."""
    return _standard().read(arabic, english)


def extracted(readings: DataFrame, key: str, arabic: str, english: str, labels: Mapping[str, tuple[Sequence[str], Sequence[str]]] = FIELD_LABELS) -> DataFrame:
    """``key``, ``field``, ``value``, ``label``: what follows a field's labels in a reading.

    Labels are tried in order; the value goes from the first place of a label, over
    blanks and colons, to the end of the line or the next label of any field.  Case
    counts in Arabic readings only.  Fields that aren't found have no row.
    """
    finder = Labels(labels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(name, *found) for name, ar, en in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True) for found in finder.read(ar, en)]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.string()) for c in columns[1:])], [key, "field", "value", "label"])

    kind = to_arrow_type(readings.schema[key].dataType)
    return readings.select(key, arabic, english).mapInArrow(rows, f"`{key}` {readings.schema[key].dataType.simpleString()}, field string, value string, label string")


def is_arabic(text: Column) -> Column:
    return text.rlike("[؀-ۿ]")


def without_confusions(text: Column) -> Column:
    """Letters that readings take for others: four Arabic ones, or pairs of Latin ones."""
    return F.when(is_arabic(text), F.translate(text, "ةىؤئ", "هيوي")).otherwise(fix_ocr_latin(text))


def cleaned_id(text: Column, numeric: bool) -> Column:
    """A number without blanks, dashes, dots and slashes.  Look-alike letters of a
    numeric one become digits, and if there were any, all else goes."""
    bare = F.regexp_replace(text, r"[\s\-./ ]", "")
    if not numeric:
        return F.upper(F.regexp_replace(bare, "[^A-Za-z0-9]", ""))
    digits = F.regexp_replace(F.translate(F.upper(bare), "ODQI|SBZG", "000115826"), "[^0-9]", "")
    return F.when(bare.rlike("(?i)[odqi|sbzg]"), digits).otherwise(bare)


def nearest_country(rows: DataFrame, value: str, most: int = 3) -> DataFrame:
    """Adds ``country``: the entry with the fewest edits, of equals the first; null beyond ``most``."""
    spark = rows.sparkSession
    entries = [(e, i, is_ar) for is_ar, part in ((True, COUNTRIES_AR), (False, COUNTRIES_EN)) for i, e in enumerate(part)]
    table = spark.createDataFrame([(e, i, a, len(e)) for e, i, a in entries], "entry string, place int, ar boolean, n int")
    asked = rows.select(F.trim(value).alias("asked")).distinct().where("asked <> ''")
    bands = asked.select("asked", is_arabic(F.col("asked")).alias("ar"), F.explode(F.sequence(F.length("asked") - most, F.length("asked") + most)).alias("n"))
    near = bands.join(F.broadcast(table), ["ar", "n"]).withColumn("d", F.levenshtein("asked", "entry", most)).where("d >= 0")  # the table is part of the code
    best = near.groupBy("asked").agg(F.min(F.struct("d", "place", "entry")).alias("b")).select("asked", F.col("b.entry").alias("country"))
    return rows.join(best, F.trim(value) == F.col("asked"), "left").drop("asked")


def processed(fields: DataFrame, key: str, arabic_names: DataFrame, latin_names: DataFrame, entry: str = "entry") -> DataFrame:
    """``key``, ``field``, ``original``, ``corrected``, ``changed`` and ``steps`` of each field (``key``, ``field``, ``value``).

    A label in front goes; confused letters are put right except in numbers; then
    numbers are cleaned, names meet the dictionary of their script word by word, and
    nationalities the countries.  Blank values have no steps.  A field of a key may
    come once.
    """
    number, field = F.col("field").isin("nationalId", "documentNo"), F.col("field")
    read = lambda bare: F.when(number, bare).otherwise(without_confusions(bare))
    cleaned = lambda r: F.when(field == "nationalId", cleaned_id(r, True)).when(field == "documentNo", cleaned_id(r, False)).otherwise(r)
    # Each step once a row: as columns of their own they would be written out again wherever a later one reads them.
    steps = bound(without_label("value", list(VALUE_LABELS)), lambda b: bound(read(b), lambda r: F.struct(b.alias("bare"), r.alias("read"), cleaned(r).alias("cleaned"))))
    rows = fields.select(key, "field", F.col("value").alias("original"), steps.alias("s")).select(key, "field", "original", "s.*")
    rows = rows.withColumn("_id", F.concat_ws("\u0001", F.col(key).cast("string"), "field"))
    named = None
    for field, dictionary, arabic in (("fullNameAr", arabic_names, True), ("fullNameEn", latin_names, False)):
        part = corrected_names(rows.where(F.col("field") == field), "_id", "cleaned", dictionary, entry, arabic).select(F.col("_id").alias("_n"), F.col("corrected").alias("name"))
        named = part if named is None else named.unionByName(part)
    rows = rows.join(named, F.col("_id") == F.col("_n"), "left")
    rows = rows.withColumn("_asked", F.when(F.col("field") == "nationality", F.col("cleaned")))
    rows = nearest_country(rows, "_asked")
    corrected = F.coalesce("name", F.when(F.col("field") == "nationality", F.col("country")), "cleaned")
    # An entry that is met exactly leaves the value as it is, blanks included.
    corrected = F.when(F.col("country") == F.trim("cleaned"), F.col("cleaned")).otherwise(corrected)
    steps = F.array_compact(
        F.array(
            F.when(F.col("bare") != F.col("original"), "label"),
            F.when(F.col("read") != F.col("bare"), "confusions"),
            F.when(F.col("cleaned") != F.col("read"), "number"),
            F.when(F.col("name") != F.col("cleaned"), "name"),
            F.when(F.col("name").isNull() & (F.col("corrected") != F.col("cleaned")), "country"),
        )
    )
    rows = rows.withColumn("corrected", corrected)
    return rows.select(key, "field", "original", "corrected", F.coalesce(F.col("corrected") != F.col("original"), F.lit(False)).alias("changed"), steps.alias("steps"))
