"""Phrases in one pass against one search a phrase."""

import random
import re

from pyspark.sql import functions as F

from attestry.operators import phrases


def by_regex(arabic, english):
    """One search a label, as said in words."""
    stops = sorted({label for pair in phrases.FIELD_LABELS.values() for part in pair for label in part}, key=len, reverse=True)
    stop = "|".join(map(re.escape, stops))
    out = {}
    for field, (ar, en) in phrases.FIELD_LABELS.items():
        for label, text, flags in [(x, arabic, 0) for x in ar] + [(x, english, re.I) for x in en]:
            m = re.search(re.escape(label) + r"[\s :：]*([^\n\r]+)", text or "", flags)
            if m:
                value = m[1].strip()
                cut = re.search(f"(?:{stop})", value, flags)
                value = value[: cut.start()].strip() if cut else value
                if value:
                    out[field] = (value, label)
                    break
    return out


def test_extraction(spark):
    rng = random.Random(4)
    pieces = [*(label for pair in phrases.FIELD_LABELS.values() for part in pair for label in part), "name", "SEX", "Dr", "محمد", "123-45", ":", "：", "\n", "\n\n", " ", " ", "  : ", "\t", "İx", "expiry DATE", "No."]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 30))), "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 30)))) for i in range(400)]
    rows += [(900, None, None), (901, "", "Name"), (902, "الرقم القومي: 29501010123456\nالاسم: محمد أحمد", ""), (903, "", "Name: A B Date of Birth: 1990-01-02 Sex M\nNationality\n: Egypt"), (904, None, "Surname:\n\n  Doe  \nName x" + " y" * 50_000)]
    got = {}
    for r in phrases.extracted(spark.createDataFrame([(*r, "x") for r in rows], "k long, ar string, en string, field string"), "k", "ar", "en").collect():
        got.setdefault(r.k, {})[r.field] = (r.value, r.label)
    assert got[902] == {"nationalId": ("29501010123456", "الرقم القومي"), "fullNameAr": ("محمد أحمد", "الاسم")}
    assert got[903]["birthDate"] == ("1990-01-02", "Date of Birth") and got[903]["nationality"] == ("Egypt", "Nationality")
    wrong = [(k, ar, en, got.get(k, {}), by_regex(ar, en)) for k, ar, en in rows if got.get(k, {}) != by_regex(ar, en)]
    assert not wrong, wrong[0]


def test_intents(spark):
    asked = ["What is LIVENESS?", "how do check digits work", "  How does it work", "tell me how it works", "show workflow", "what's new", "whatever", "security of a document", "security only", "document only", "the MRZ and bias", "", None, "validate luhn", "somehow", "İ drift", "x" * 30_000 + "mule", "what  security feature"]
    got = [r[1] for r in sorted(spark.createDataFrame(list(enumerate(asked)), "i int, q string").select("i", phrases.intent(F.col("q"))).collect())]

    def one(q):
        q = (q or "").lower().strip()
        for name, each in phrases.INTENTS:
            for e in each:
                parts = (e,) if isinstance(e, str) else e
                if all(q.startswith(p[1:]) if p[0] == "^" else p in q for p in parts):
                    return name
        return "default"

    assert got == [one(q) for q in asked]
    assert got[:8] == ["liveness", "mrz", "how_does", "how_does", "how_does", "what_is", "default", "security_features"]


def test_pipeline(spark):
    rows = [
        (1, "nationalId", "National ID: 295O1O1-0123456"),
        (1, "documentNo", "a 12.3/b-4"),
        (1, "fullNameEn", "Name: Jahn  Srnith"),
        (1, "fullNameAr", "الاسم: احمد"),
        (1, "nationality", "Egipt"),
        (1, "address", "12 clown vvay"),
        (2, "nationalId", "12A45"),
        (2, "nationality", " Egypt "),
        (2, "fullNameEn", None),
        (2, "nationality2", ""),
        (3, "nationality", "Zzzzzzzzzz"),
        (3, "fullNameEn", "   "),
        (3, "nationality3", "ليبيا"),
        (4, "nationality", "لبيا"),
    ]
    latin = spark.createDataFrame([("John",), ("Smith",)], "entry string")
    arabic = spark.createDataFrame([("أحمد",), ("محمد",)], "entry string")
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "k int, field string, value string, name string, country string")
    got = {(r.k, r.field): (r.corrected, r.changed, r.steps) for r in phrases.processed(df, "k", arabic, latin).collect()}
    assert len(got) == len(rows)
    assert got[1, "nationalId"] == ("295010101" + "23456", True, ["label", "number"])
    assert got[1, "documentNo"] == ("A123B4", True, ["number"])
    assert got[1, "fullNameEn"] == ("John Smith", True, ["label", "confusions", "name"])
    assert got[1, "fullNameAr"] == ("أحمد", True, ["label", "name"])
    assert got[1, "nationality"] == ("Egypt", True, ["country"])
    assert got[1, "address"] == ("12 down way", True, ["confusions"])
    assert got[2, "nationalId"] == ("12A45", False, [])
    assert got[2, "nationality"] == (" Egypt ", False, [])
    assert got[2, "fullNameEn"] == (None, False, []) and got[2, "nationality2"] == ("", False, [])
    assert got[3, "nationality"][0] == "Zzzzzzzzzz" and got[3, "fullNameEn"] == ("   ", False, [])
    assert got[4, "nationality"] == ("ليبيا", True, ["country"])
