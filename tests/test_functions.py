import random

import pytest
from pyspark.sql import functions as F

from attestry.functions import checksums, mrz, numbers, text
from attestry.sources import generators


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values) or "x int"
    row = tuple(values.values()) or (1,)
    return spark.createDataFrame([row], names).select(column.alias("r")).first().r


def valid(spark, pairs):
    df = spark.createDataFrame(pairs, "country string, id string")
    return [(r.is_valid, r.checksum_valid) for r in checksums.validate(df).select("*", F.monotonically_increasing_id().alias("o")).orderBy("o").collect()]


def luhn(body):
    for last in "0123456789":
        s = body + last
        total = 0
        for i, ch in enumerate(reversed(s)):
            d = int(ch) * (2 if i % 2 else 1)
            total += d - 9 if d > 9 else d
        if total % 10 == 0:
            return s


def mod11(body, weights, rule):
    return rule(sum(int(c) * w for c, w in zip(body, weights)) % 11)


def test_checksums_against_plain_python(spark):
    rng = random.Random(1)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    cases, want = [], []
    for _ in range(40):
        for cc, n in (("CA", 9), ("IL", 9), ("PS", 9), ("BH", 9), ("ZA", 13), ("SE", 10), ("SA", 10), ("BD", 10)):
            s = luhn(digits(n - 1))
            broken = s[:-1] + str((int(s[-1]) + 1) % 10)
            cases += [(cc, s), (cc, broken)]
            want += [(True, True), (True, False)]
        b = digits(10)
        for cc in ("SD", "NG"):
            r = mod11(b, range(11, 1, -1), lambda r: r if r < 2 else 11 - r)
            cases.append((cc, b + str(r)))
            want.append((True, True))
        b = digits(12)
        r = (11 - sum(int(c) * w for c, w in zip(b, range(13, 1, -1))) % 11) % 10
        cases += [("TH", b + str(r)), ("TH", b + str((r + 3) % 10))]
        want += [(True, True), (True, False)]
        b = digits(10)
        p = 10
        for ch in b:
            s = (p + int(ch)) % 10 or 10
            p = s * 2 % 11
        cases.append(("HR", b + str((11 - p) % 10)))
        want.append((True, True))
        n = digits(8)
        cases += [("ES", n + "TRWAGMYFPDXBNJZSQVHLCKE"[int(n) % 23]), ("ES", "X" + n[1:] + "TRWAGMYFPDXBNJZSQVHLCKE"[int(n[1:]) % 23])]
        want += [(True, True)] * 2
        b = "1" + digits(12)
        cases.append(("FR", b + f"{97 - int(b) % 97:02d}"))
        want.append((True, True))
        # Verhoeff: search the digit that closes the permutation product.
        b = str(rng.randrange(2, 10)) + digits(10)
        for last in "0123456789":
            c = 0
            for i, ch in enumerate(reversed(b + last)):
                c = int(checksums.VERHOEFF_D[c][int(checksums.VERHOEFF_P[i % 8][int(ch)])])
            if c == 0:
                cases.append(("IN", b + last))
                want.append((True, True))
        body = digits(8)
        total = sum(int(c) * (2 + i % 6) for i, c in enumerate(reversed(body)))
        cases.append(("CL", body + {0: "0", 1: "K"}.get(total % 11, str(11 - total % 11))))
        want.append((True, True))
    assert valid(spark, cases) == want


def test_shapes_and_unknown_countries(spark):
    got = valid(spark, [("US", "123-45-6789"), ("US", "666-45-6789"), ("US", "900456789"), ("GB", "AB 12 34 56 C"), ("GB", "QQ123456C"), ("XX", "1"), ("IR", "1111111111"), ("BR", "11111111111"), ("EG", None), ("MY", "900101145555"), ("PK", "123"), ("AE", "123456789012345")])
    assert got == [(True, True), (False, False), (False, False), (True, True), (False, False), (False, False), (False, False), (False, False), (False, False), (True, True), (False, False), (False, False)]
    assert len(checksums.supported_countries()) == 75 == len(set(checksums.supported_countries()))


def test_decoding(spark):
    df = spark.createDataFrame([("EG", "29503150112345"), ("PL", "02270803628"), ("KR", "9501011234567"), ("DK", "0101904001"), ("CZ", "925101123"), ("NO", "01019051234")], "country string, id string")
    got = {r.country: (r.birth_year, r.birth_month, r.birth_day, r.sex) for r in checksums.validate(df).collect()}
    assert got == {"EG": (1995, 3, 15, "Female"), "PL": (2002, 7, 8, "Female"), "KR": (1995, 1, 1, "Male"), "DK": (1990, 1, 1, "Male"), "CZ": (1992, 1, 1, "Female"), "NO": (1990, 1, 1, "Female")}


TD1 = "I<UTOD231458907<<<<<<<<<<<<<<<\n7408122F1204159UTO<<<<<<<<<<<6\nERIKSSON<<ANNA<MARIA<<<<<<<<<<"
TD2 = "I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<\nD231458907UTO7408122F1204159<<<<<<<6"
TD3 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"


@pytest.mark.parametrize("zone,kind,plain,icao", [(TD1, "TD1", False, True), (TD2, "TD2", True, True), (TD3, "TD3", False, True)])
def test_zones(spark, zone, kind, plain, icao):
    z = one(spark, mrz.parse(F.col("t")), t=zone)
    assert (z.format, z.surname, z.given, z.sex, z.birth_date, z.nationality) == (kind, "ERIKSSON", "ANNA MARIA", "Female", "1974-08-12", "UTO")
    assert (z.number_ok, z.birth_ok, z.expiry_ok, z.composite_ok) == (True, True, True, plain)
    assert one(spark, mrz.parse(F.col("t"), "icao"), t=zone).composite_ok is icao


def test_zone_digits_and_junk(spark):
    assert [one(spark, mrz.check_digit(F.col("t")), t=t) for t in ("D23145890", "740812", "120415")] == [7, 2, 9]
    assert one(spark, mrz.parse(F.col("t")), t="hello\nworld") is None
    assert one(spark, mrz.parse(F.col("t")), t=None) is None


def test_generated_zones_validate(spark):
    z = generators.zones(generators.identities(spark, 200), corrupt_every=5).withColumn("m", mrz.parse(F.col("mrz_text")))
    assert {(r.id % 5 != 0, r.v) for r in z.select("id", F.col("m.valid").alias("v")).collect()} == {(True, True), (False, False)}
    ids = generators.luhn_ids(spark, 200, corrupt_every=4)
    got = checksums.validate(ids.withColumn("country", F.lit("CA")), raw="national_id")
    assert got.where("checksum_valid <> expect_valid").count() == 0
    assert generators.identities(spark, 50).exceptAll(generators.identities(spark, 50).repartition(7)).count() == 0


@pytest.mark.parametrize(
    "expected,actual,ok",
    [(None, "x", True), ("abc", None, False), ("John Smith", "JOHN-SMITH", True), ("Mohamed Ali", "Mohamed", True), ("abcd", "abcx", True), ("abcd", "abxy", False), ("abcdefgh", "abcdefxy", True), ("abcdefgh", "abcdexyz", False), ("abcdefghijkl", "abcdefghixyz", True), ("abcdefghijkl", "abcdefghwxyz", False), ("أحمد", "احمد", True), ("١٢٣", "123", True)],
)
def test_field_matches(spark, expected, actual, ok):
    assert one(spark, text.field_matches("a", "b"), a=expected, b=actual) is ok


def test_texts(spark):
    assert one(spark, text.digits_only("t"), t="٠١٢-۳۴ x5") == "012345"
    assert one(spark, text.normalize_arabic("t"), t="  أحـمد   علىّ ") == "احمد عليّ"
    assert one(spark, text.masked("t"), t="12345678") == "********" and one(spark, text.masked("t"), t="1234567890") == "1234****7890"
    assert one(spark, text.sanitize("t"), t=" a\x00b\x07 ") == "ab" and one(spark, text.sanitize("t"), t="  ") is None
    assert [one(spark, text.normalize_date("t"), t=t) for t in ("2020-01-31", "1/2/99", "1.2.2005", "5 يناير 2001", "nonsense", "2020-13-01")] == ["2020-01-31", "1999-02-01", "2005-02-01", "2001-01-05", "nonsense", "2020-13-01"]
    assert [one(spark, text.normalize_gender("t"), t=t) for t in ("M", "female", "ذكر", "أنثى", "x", None)] == ["Male", "Female", "Male", "Female", None, None]
    assert one(spark, text.transliterate("t"), t="خالد") == "khald"
    assert one(spark, text.name_overlap("a", "b"), a="Omar", b="OMAR HASSAN") == 1.0 and one(spark, text.name_overlap("a", "b"), a="ab", b="abc") is None
    assert one(spark, text.clean_numeric_id("t"), t="O1S-B2") == "01582"
    assert one(spark, text.similarity("a", "b"), a="abcd", b="ABCE") == 0.75
    assert one(spark, text.page_title("t"), t="<html><TITLE> A  b </TITLE>") == "A b" and one(spark, text.page_links("t"), t='<a href="/x">1</a><A class=c HREF=\'y\'>') == ["/x", "y"]
    assert one(spark, text.strip_tags("t"), t="<p>a<script>var x;</script> b</p>") == "a b"
    assert one(spark, text.aamva_fields("t"), t="DAQ123\nDCSDOE\nDAQ456") == {"DAQ": "456", "DCS": "DOE"}
    assert [one(spark, text.qr_kind("t"), t=t) for t in ('{"a":1}', "https://x.y", "a=1;b=2", "QUJDREVGR0hJSktMTU5P", "hello")] == ["json", "url", "pairs", "base64", "text"]
    assert one(spark, text.script("t"), t="abc") == "latin" and one(spark, text.script("t"), t="ابc") == "mixed"


def test_numbers(spark):
    def val(c):
        return one(spark, c)

    assert val(numbers.half_up(F.lit(-2.5))) == -2 and val(numbers.half_up(F.lit(2.5))) == 3 and val(numbers.half_up(F.lit(1.2345), 2)) == 1.23
    assert 5560 < val(numbers.haversine_km(F.lit(51.5074), F.lit(-0.1278), F.lit(40.7128), F.lit(-74.006))) < 5580
    assert val(numbers.ratio(F.lit(1), F.lit(0))) == 0 and val(numbers.sigmoid(F.lit(-800.0))) == 0.0 and val(numbers.sigmoid(F.lit(0.0))) == 0.5
    assert abs(val(numbers.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) - 0.70710678) < 1e-6
    assert val(numbers.linear_model(F.array(F.lit(1.0)), [0.0, 5.0])) == 0.5
    box = lambda x, y, w, h: F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((x, y, w, h), "xywh")])
    assert abs(val(numbers.iou(box(0, 0, 2, 2), box(1, 1, 2, 2))) - 1 / 7) < 1e-9 and val(numbers.centre_distance(box(0, 0, 2, 2), box(3, 4, 2, 2))) == 5
    empty = F.array().cast("array<double>")
    assert val(numbers.mean(empty)) == 0 and val(numbers.deviation(F.array(F.lit(1.0), F.lit(3.0)))) == 1
