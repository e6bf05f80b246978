"""Each code of the cross-field rules, on a record that is otherwise clean."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions import mrz
from attestry.operators import rules

AS_OF = "2025-06-01"
TABLES = {"places": {"US": ["washington", "denver"]}, "numbers": {"US": "^[A-Z]{2}[0-9]{6}$"}, "names": ["محمد", "أحمد"], "dual": {"US": ["ca", "gb"]}}
ID = {"is_valid": True, "checksum_valid": True, "birth_year": 1990, "birth_month": 5, "birth_day": 20, "sex": "Male"}
ZONE = {"number": "AB123456", "birth_date": "1990-05-20", "expiry_date": "2028-01-01", "nationality": "USA", "sex": "Male", "surname": "SMITH", "given": "JOHN", "number_ok": True, "birth_ok": True, "expiry_ok": True, "composite_ok": True}
OTHER = {"birth_date": "1990-05-20", "full_name_en": "John Smith", "full_name_ar": None, "gender": "Male"}
BASE = {
    "full_name_ar": None, "full_name_en": "John Smith", "national_id": "123456789", "country": "US", "birth_date": "1990-05-20", "gender": "Male", "expiry_date": "2028-01-01", "issue_date": "2018-01-01",
    "nationality": "US", "document_no": "AB123456", "doc_type": "national_id", "photo_present": True, "photo_gender": "Male", "biometric_variance": 0.1, "address": "1 Main Street, Denver, CO 80202", "issue_place": "Denver", "mrz": None, "id": ID, "other_documents": None,
}

#: What is changed, and the codes that must come of it (others may come too).
CASES = [
    ({"id": ID | {"is_valid": False}}, ["ID_FORMAT_INVALID"]),
    ({"id": ID | {"checksum_valid": False}}, ["ID_CHECKSUM_MISMATCH"]),
    ({"id": ID | {"sex": "Female"}}, ["GENDER_MISMATCH_ID"]),
    ({"id": ID | {"birth_year": 1991}}, ["BIRTHDATE_YEAR_MISMATCH"]),
    ({"id": ID | {"birth_day": 21}}, ["BIRTHDATE_MISMATCH"]),
    ({"full_name_ar": "محمد Smith"}, ["ARABIC_NAME_HAS_LATIN"]),
    ({"full_name_ar": "محمد 7 أحمد"}, ["ARABIC_NAME_HAS_NON_ARABIC"]),
    ({"full_name_en": "John محمد"}, ["ENGLISH_NAME_HAS_ARABIC"]),
    ({"full_name_en": "John Sm1th"}, ["ENGLISH_NAME_HAS_NON_LATIN"]),
    ({"birth_date": "2026-01-01"}, ["BIRTHDATE_FUTURE"]),
    ({"birth_date": "1900-01-01"}, ["BIRTHDATE_TOO_OLD"]),
    ({"birth_date": "2012-01-01"}, ["AGE_MINOR"]),
    ({"birth_date": "1915-01-01"}, ["AGE_VERY_ELDERLY"]),
    ({"expiry_date": "2024-01-01"}, ["DOCUMENT_EXPIRED"]),
    ({"expiry_date": "2025-06-20"}, ["DOCUMENT_EXPIRING_SOON"]),
    ({"nationality": "FR"}, ["NATIONALITY_COUNTRY_MISMATCH", "NATIONALITY_DUAL_CITIZEN_UNVERIFIED"]),
    ({"nationality": "CA"}, ["NATIONALITY_COUNTRY_MISMATCH", "NATIONALITY_DUAL_CITIZEN_VERIFIED"]),
    ({"mrz": ZONE | {"number_ok": False}}, ["MRZ_DOCNUM_CHECKSUM_FAIL"]),
    ({"mrz": ZONE | {"birth_ok": False}}, ["MRZ_BIRTH_CHECKSUM_FAIL"]),
    ({"mrz": ZONE | {"expiry_ok": False}}, ["MRZ_EXPIRY_CHECKSUM_FAIL"]),
    ({"mrz": ZONE | {"composite_ok": False}}, ["MRZ_COMPOSITE_CHECKSUM_FAIL"]),
    ({"mrz": ZONE | {"surname": "WILLIAMS", "given": "PETER"}}, ["MRZ_NAME_MISMATCH"]),
    ({"mrz": ZONE | {"surname": "SMYTH", "given": "JONN"}}, ["MRZ_NAME_NEAR_MATCH"]),
    ({"mrz": ZONE | {"number": "ZZ999999"}}, ["MRZ_DOCNUM_MISMATCH"]),
    ({"mrz": ZONE | {"nationality": "FRA"}}, ["MRZ_NATIONALITY_MISMATCH"]),
    ({"mrz": ZONE | {"birth_date": "1991-05-20"}}, ["MRZ_BIRTHDATE_MISMATCH"]),
    ({"mrz": ZONE | {"birth_date": "1990-05-21"}}, ["MRZ_BIRTHDATE_DAY_MISMATCH"]),
    ({"mrz": ZONE | {"sex": "Female"}}, ["MRZ_GENDER_MISMATCH"]),
    ({"mrz": ZONE | {"expiry_date": "2029-01-01"}}, ["MRZ_EXPIRY_MISMATCH"]),
    ({"mrz": ZONE | {"expiry_date": "2024-01-01"}}, ["MRZ_EXPIRY_PAST_GRACE"]),
    ({"mrz": ZONE | {"expiry_date": "2025-05-01"}}, ["MRZ_EXPIRY_RECENTLY_EXPIRED"]),
    ({"expiry_date": "2017-01-01"}, ["EXPIRY_BEFORE_ISSUE"]),
    ({"expiry_date": "2036-01-01"}, ["VALIDITY_PERIOD_TOO_LONG"]),
    ({"doc_type": "passport", "expiry_date": "2026-01-01"}, ["PASSPORT_VALIDITY_UNUSUAL"]),
    ({"issue_date": "2025-07-01"}, ["ISSUE_DATE_FUTURE"]),
    ({"birth_date": "2019-01-01"}, ["ISSUE_BEFORE_BIRTH"]),
    ({"birth_date": "2008-01-01"}, ["ISSUED_TO_MINOR"]),
    ({"photo_gender": "Female"}, ["PHOTO_GENDER_HEURISTIC_MISMATCH"]),
    ({"full_name_ar": "محمد"}, ["ARABIC_NAME_TOO_SHORT"]),
    ({"full_name_en": "John"}, ["ENGLISH_NAME_TOO_SHORT"]),
    ({"national_id": " "}, ["MISSING_REQUIRED_FIELD"]),
    ({"issue_date": "01/01/2018"}, ["DATE_FORMAT_NON_ISO"]),
    ({"gender": "non-binary"}, ["GENDER_OTHER_ACCEPTED"]),
    ({"gender": "zzz"}, ["GENDER_UNRECOGNIZED"]),
    ({"document_no": "A1"}, ["DOCUMENT_NUMBER_FORMAT_MISMATCH", "DOCUMENT_NUMBER_FORMAT_BY_COUNTRY"]),
    ({"document_no": "123456789"}, ["DOCUMENT_NUMBER_FORMAT_BY_COUNTRY"]),
    ({"full_name_ar": "عبدالرحمن قسطنطين"}, ["CROSS_LANGUAGE_NAME_MISMATCH", "ARABIC_NAME_NOT_IN_DICTIONARY"]),
    ({"issue_date": "2025-05-20", "expiry_date": "2025-05-25"}, ["RECENTLY_ISSUED_BUT_EXPIRED"]),
    ({"address": "nowhere at all"}, ["ADDRESS_FORMAT_US_NO_ZIP"]),
    ({"country": "EG", "nationality": "EG", "address": "12 Nile Street"}, ["ADDRESS_FORMAT_AR_NO_ARABIC", "NATIONALITY_LANGUAGE_ARABIC_EXPECTED"]),
    ({"country": "IR", "nationality": "IR", "address": "12 Azadi Street"}, ["ADDRESS_FORMAT_IR_NO_PERSIAN"]),
    ({"photo_present": False}, ["PHOTO_MISSING"]),
    ({"doc_type": "passport", "issue_date": "2005-01-01"}, ["DOCUMENT_AGE_PASSPORT_TOO_OLD"]),
    ({"issue_date": "2005-01-01"}, ["DOCUMENT_AGE_EXPIRED_BY_REISSUANCE"]),
    ({"biometric_variance": 1.5}, ["BIOMETRIC_VARIANCE_OUT_OF_RANGE"]),
    ({"biometric_variance": 0.6}, ["BIOMETRIC_VARIANCE_HIGH_DIFFERENT_PERSON"]),
    ({"biometric_variance": 0.3}, ["BIOMETRIC_VARIANCE_SUSPICIOUS"]),
    ({"other_documents": [OTHER | {"birth_date": "1990-06-20"}]}, ["CROSS_DOC_BIRTHDATE_DAY_MISMATCH"]),
    ({"other_documents": [OTHER | {"birth_date": "1980-05-20"}]}, ["CROSS_DOC_BIRTHDATE_MISMATCH"]),
    ({"other_documents": [OTHER | {"full_name_en": "Peter Williams"}]}, ["CROSS_DOC_NAME_MISMATCH"]),
    ({"other_documents": [OTHER | {"full_name_en": "John Williams"}]}, ["CROSS_DOC_NAME_PARTIAL_MATCH"]),
    ({"full_name_ar": "محمد أحمد", "other_documents": [OTHER | {"full_name_ar": "علي حسن"}]}, ["CROSS_DOC_ARABIC_NAME_MISMATCH"]),
    ({"other_documents": [OTHER | {"gender": "Female"}]}, ["CROSS_DOC_GENDER_MISMATCH"]),
    ({"full_name_en": "محمد أحمد"}, ["NATIONALITY_LANGUAGE_LATIN_EXPECTED"]),
    ({"issue_place": "Atlantis"}, ["ISSUE_PLACE_UNKNOWN"]),
]


TEXTS = ("full_name_ar", "full_name_en", "national_id", "country", "birth_date", "gender", "expiry_date", "issue_date", "nationality", "document_no", "doc_type", "photo_gender", "address", "issue_place")


def schema(spark):
    zone = spark.range(1).select(mrz.parse(F.lit("x")).alias("m")).schema["m"].dataType
    zone = T.StructType([T.StructField(f.name, f.dataType) for f in zone])
    rest = T.StructType.fromDDL("photo_present boolean, biometric_variance double, id struct<is_valid: boolean, checksum_valid: boolean, birth_year: bigint, birth_month: bigint, birth_day: bigint, sex: string>, other_documents array<struct<birth_date: string, full_name_en: string, full_name_ar: string, gender: string>>")
    return T.StructType([*[T.StructField(n, T.StringType()) for n in TEXTS], *rest.fields, T.StructField("mrz", zone)])


@pytest.fixture(scope="module")
def found(spark):
    """Codes of the base record (number -1) and of each case."""
    kind = schema(spark)
    dates = {f.name for f in kind["mrz"].dataType if isinstance(f.dataType, T.DateType)}

    def record(change):
        r = BASE | change
        zone = r["mrz"]
        if zone is not None:
            zone = {f.name: zone.get(f.name) for f in kind["mrz"].dataType}
            zone = {k: datetime.date.fromisoformat(v) if k in dates and v else v for k, v in zone.items()}
        return {**r, "mrz": zone}

    rows = [record({}), record({"mrz": ZONE, "other_documents": [OTHER]}), *[record(c) for c, _ in CASES]]
    df = spark.createDataFrame([(i, *[r[n] for n in kind.names]) for i, r in enumerate(rows)], T.StructType([T.StructField("i", T.IntegerType()), *kind.fields])).coalesce(2)
    out = df.select("i", rules.validation(rules.cross_field(F.lit(AS_OF).cast("date"), **TABLES)).alias("v")).collect()
    return {r.i - 2: set(r.v.codes) for r in out}


def test_clean_records(found):
    assert found[-2] == set() and found[-1] == set()


@pytest.mark.parametrize("number", range(len(CASES)), ids=lambda i: CASES[i][1][0])
def test_code(found, number):
    assert set(CASES[number][1]) <= found[number]


def test_other_codes_stay_away(found):
    """A code comes only where something it reads has been changed: most cases have theirs alone."""
    alone = sum(found[i] == set(codes) for i, (_, codes) in enumerate(CASES))
    assert alone > len(CASES) * 0.6
