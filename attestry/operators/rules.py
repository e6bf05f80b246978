"""Rule engines: a row to an array of flags, to a score, to a decision.

A flag is a struct of ``code`` and ``severity``; rules are Columns that give a
flag or null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.numbers import clamp, half_up
from attestry.functions.text import canonical, has_arabic, has_latin, transliterate

#: Weight of a severity in the score, and in the fraud probability.
SCORE_WEIGHTS = {"critical": 1.0, "error": 0.5, "warning": 0.2, "info": 0.0}
FRAUD_WEIGHTS = {"critical": 0.3, "error": 0.15, "warning": 0.05, "info": 0.0}

#: Weights of the risk fusion.
RISK_WEIGHTS = {
    "document_authenticity": 0.18,
    "face_match": 0.20,
    "liveness": 0.15,
    "device_signals": 0.05,
    "cross_field_consistency": 0.10,
    "document_authenticity_features": 0.08,
    "face_match_confidence": 0.10,
    "liveness_confidence": 0.08,
    "ai_consensus_confidence": 0.04,
    "ocr_confidence": 0.02,
}


def flag(when: Column, code: str, severity: str) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))


def flags(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def _weigh(found: Column, table: dict[str, float]) -> Column:
    w = lambda f: reduce(lambda c, kv: c.when(f["severity"] == kv[0], kv[1]), table.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    return F.aggregate(found, F.lit(0.0), lambda s, f: s + w(f))


def count(found: Column, *severities: str) -> Column:
    return F.size(F.filter(found, lambda f: f["severity"].isin(*severities)))


def validation(found: Column) -> Column:
    """Score, fraud probability and worst severities of a row's flags."""
    return F.struct(
        half_up(clamp(1 - _weigh(found, SCORE_WEIGHTS)), 3).alias("score"),
        half_up(F.least(F.lit(1.0), _weigh(found, FRAUD_WEIGHTS)), 3).alias("fraud_probability"),
        (count(found, "critical") > 0).alias("has_critical"),
        (count(found, "critical", "error") > 0).alias("has_errors"),
        F.transform(found, lambda f: f["code"]).alias("codes"),
    )


def fraud(found: Column) -> Column:
    """Risk and score by the counts of critical flags, warnings and infos."""
    c, w, i = count(found, "critical"), count(found, "warning"), count(found, "info")
    risk = F.when(c > 0, "blocked").when(w > 0, "medium").otherwise("low")
    score = F.when(c > 0, F.greatest(F.lit(0), 100 - 40 * c - 15 * w)).when(w > 0, F.greatest(F.lit(20), 100 - 20 * w - 5 * i)).otherwise(F.greatest(F.lit(60), 100 - 5 * i))
    return F.struct(risk.alias("risk"), score.alias("score"))


def age_flags(birth: str, expiry: str, as_of: Column, least_age: int = 18) -> list[Column]:
    age = F.datediff(as_of, F.col(birth)) / 365.25
    left = F.datediff(F.col(expiry), as_of)
    return [
        flag(age < least_age, "UNDERAGE", "critical"),
        flag(age > 120, "AGE_IMPLAUSIBLE", "warning"),
        flag(left < 0, "DOCUMENT_EXPIRED", "critical"),
        flag((left >= 0) & (left < 30), "EXPIRING_SOON", "info"),
    ]


def blacklisted(name: str, entries: list[str]) -> Column:
    """Whether a trimmed, lower-cased name contains an entry."""
    s = F.lower(F.trim(F.col(name)))
    return F.coalesce(F.exists(F.array(*[F.lit(e.strip().lower()) for e in entries]), lambda e: F.contains(s, e)), F.lit(False))


def _date(c: str) -> Column:
    return F.col(c).try_cast("date")


#: Fewest and most name parts that are usual, by country.
NAME_PARTS = {
    "EG": (3, 6), "SA": (2, 6), "AE": (2, 6), "KW": (2, 6), "QA": (2, 6), "BH": (2, 6), "OM": (2, 6), "YE": (2, 6), "JO": (2, 6), "PS": (2, 6), "LB": (3, 6), "SY": (2, 6), "IQ": (2, 6), "SD": (2, 6),
    "LY": (2, 6), "DZ": (2, 6), "TN": (2, 6), "MA": (2, 6), "MR": (2, 6), "IR": (2, 5), "AF": (2, 5), "US": (2, 4), "GB": (2, 4), "FR": (2, 5), "DE": (2, 5), "ES": (2, 4), "IT": (2, 5), "NL": (2, 4),
    "BE": (2, 4), "BR": (2, 6), "VN": (2, 5), "TH": (2, 5), "KH": (2, 5), "ID": (2, 5), "MY": (2, 5), "SG": (2, 5), "BD": (2, 5), "LK": (2, 5), "NP": (2, 5), "NG": (2, 5), "GH": (2, 5), "MU": (2, 5),
}

#: Patterns that an address has, by country.
ADDRESS_PATTERNS = {"US": (r"\b[0-9]{5}(-[0-9]{4})?\b", "ADDRESS_FORMAT_US_NO_ZIP"), "CA": (r"(?i)\b[A-Z][0-9][A-Z] ?[0-9][A-Z][0-9]\b", "ADDRESS_FORMAT_CA_NO_POSTCODE"), "GB": (r"(?i)\b[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2}\b", "ADDRESS_FORMAT_GB_NO_POSTCODE")}

#: Countries whose addresses and names are in Arabic, whose IDs
#: are not given to children, and whose cards don't run out.
ARABIC_COUNTRIES = ("EG", "SA", "AE", "KW", "QA", "BH", "OM", "JO", "LB", "IQ", "SY", "YE", "PS", "SD", "LY", "TN", "DZ", "MA")
ADULT_ID_COUNTRIES = ("EG", "SA", "AE", "KW")
INDEFINITE_COUNTRIES = ("IN", "PK")


def _words(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.trim(c), r"\s+"), lambda t: F.length(t) > 1)


def _parts(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != "")


def _least_edits(word: Column, others: Column) -> Column:
    return F.array_min(F.transform(others, lambda o: F.levenshtein(word, o)))


def cross_field(as_of: Column, grace_days: int = 180, places: dict[str, list[str]] | None = None, numbers: dict[str, str] | None = None, names: list[str] | None = None, dual: dict[str, list[str]] | None = None) -> Column:
    """Flags of one identity record across its own fields.

    Reads: full_name_ar, full_name_en, national_id, country, birth_date, gender,
    expiry_date, issue_date, nationality, document_no, doc_type, photo_present,
    photo_gender, biometric_variance, address, issue_place, mrz (struct of
    ``functions.mrz.parse``), and id (struct: is_valid, checksum_valid,
    birth_year, birth_month, birth_day, sex), and other_documents (array of
    structs birth_date, full_name_en, full_name_ar, gender).  A rule whose fields
    are missing gives no flag.  ``places`` (issuing places by country),
    ``numbers`` (patterns of document numbers by country), ``names`` (known
    Arabic name parts) and ``dual`` (further nationalities by country) switch
    their rules on.
    """
    birth, expiry, issue = _date("birth_date"), _date("expiry_date"), _date("issue_date")
    ar, en, gender, country = F.col("full_name_ar"), F.col("full_name_en"), F.col("gender"), F.upper("country")
    years = lambda a, b: F.datediff(b, a) / 365.25
    id_, mrz = F.col("id"), F.col("mrz")
    given = F.coalesce(F.col("national_id"), F.lit("")) != ""
    kind = F.col("doc_type")
    age, valid_for, since_issue, age_at_issue = years(birth, as_of), years(issue, expiry), years(issue, as_of), years(birth, issue)
    no_text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    iso = r"^\d{4}-\d{2}-\d{2}$"
    same_year = lambda a, b: F.year(a) == F.year(b)
    mrz_birth, mrz_expiry = mrz["birth_date"].try_cast("date"), mrz["expiry_date"].try_cast("date")
    mrz_words, en_words = _words(F.lower(F.concat_ws(" ", mrz["given"], mrz["surname"]))), _words(F.lower(en))
    unshared = (F.size(mrz_words) > 0) & (F.size(en_words) > 0) & (F.size(F.filter(F.array_intersect(mrz_words, en_words), lambda t: F.length(t) > 2)) == 0)
    name_gap = F.array_min(F.transform(mrz_words, lambda w: _least_edits(w, en_words)))
    docs = [canonical(mrz["number"]), canonical("document_no")]
    # The Arabic part furthest from all Latin parts.
    latin_gap = F.array_max(F.transform(_words("full_name_ar"), lambda w: _least_edits(F.lower(transliterate(w)), F.transform(en_words, lambda e: e))))
    others, mine = F.col("other_documents"), F.struct("birth_date", "full_name_en", "full_name_ar", "gender")
    any_other = lambda test: F.exists(others, test)
    shared = lambda a, b: F.size(F.array_intersect(_words(F.lower(a)), _words(F.lower(b))))
    both = lambda a, b: a.isNotNull() & b.isNotNull()
    parts = F.size(_parts(F.when(has_arabic("full_name_ar"), ar).otherwise(en)))
    arabic_home = country.isin(*ARABIC_COUNTRIES)
    address = F.trim("address")
    long_address = F.length(address) >= 5
    rules = [
        flag(given & ~id_["is_valid"], "ID_FORMAT_INVALID", "error"),
        flag(given & id_["is_valid"] & ~id_["checksum_valid"], "ID_CHECKSUM_MISMATCH", "critical"),
        flag(id_["sex"] != gender, "GENDER_MISMATCH_ID", "critical"),
        flag(id_["birth_year"] != F.year(birth), "BIRTHDATE_YEAR_MISMATCH", "error"),
        flag((id_["birth_year"] == F.year(birth)) & ((id_["birth_month"] != F.month(birth)) | (id_["birth_day"] != F.day(birth))), "BIRTHDATE_MISMATCH", "warning"),
        flag(has_latin("full_name_ar"), "ARABIC_NAME_HAS_LATIN", "warning"),
        flag(~has_latin("full_name_ar") & ar.rlike(r"[^\p{InArabic}\s\-.']"), "ARABIC_NAME_HAS_NON_ARABIC", "warning"),
        flag(has_arabic("full_name_en"), "ENGLISH_NAME_HAS_ARABIC", "warning"),
        flag(~has_arabic("full_name_en") & en.rlike(r"[^\p{IsLatin}\s\-.']"), "ENGLISH_NAME_HAS_NON_LATIN", "warning"),
        flag(birth > as_of, "BIRTHDATE_FUTURE", "error"),
        flag(age > 120, "BIRTHDATE_TOO_OLD", "warning"),
        flag((age >= 0) & (age < 16), "AGE_MINOR", "info"),
        flag((age > 100) & (age <= 120), "AGE_VERY_ELDERLY", "warning"),
        flag(expiry < as_of, "DOCUMENT_EXPIRED", "error"),
        flag((expiry >= as_of) & (F.datediff(expiry, as_of) < 30), "DOCUMENT_EXPIRING_SOON", "info"),
        flag(F.upper("nationality") != country, "NATIONALITY_COUNTRY_MISMATCH", "warning"),
        flag(~mrz["number_ok"], "MRZ_DOCNUM_CHECKSUM_FAIL", "critical"),
        flag(~mrz["birth_ok"], "MRZ_BIRTH_CHECKSUM_FAIL", "error"),
        flag(~mrz["expiry_ok"], "MRZ_EXPIRY_CHECKSUM_FAIL", "error"),
        flag(~mrz["composite_ok"], "MRZ_COMPOSITE_CHECKSUM_FAIL", "critical"),
        flag(unshared & (name_gap > 2), "MRZ_NAME_MISMATCH", "error"),
        flag(unshared & (name_gap <= 2), "MRZ_NAME_NEAR_MATCH", "info"),
        flag(~(F.contains(docs[0], docs[1]) | F.contains(docs[1], docs[0])), "MRZ_DOCNUM_MISMATCH", "error"),
        flag(F.left(mrz["nationality"], F.lit(2)) != F.left(F.upper("nationality"), F.lit(2)), "MRZ_NATIONALITY_MISMATCH", "warning"),
        flag(~same_year(mrz_birth, birth), "MRZ_BIRTHDATE_MISMATCH", "error"),
        flag(same_year(mrz_birth, birth) & (mrz_birth != birth), "MRZ_BIRTHDATE_DAY_MISMATCH", "warning"),
        flag(mrz["sex"] != gender, "MRZ_GENDER_MISMATCH", "critical"),
        flag(~same_year(mrz_expiry, expiry), "MRZ_EXPIRY_MISMATCH", "warning"),
        flag(valid_for <= 0, "EXPIRY_BEFORE_ISSUE", "error"),
        flag(valid_for > 15, "VALIDITY_PERIOD_TOO_LONG", "warning"),
        flag((kind == "passport") & (valid_for > 0) & (valid_for != 5) & (valid_for != 10) & (valid_for < 15), "PASSPORT_VALIDITY_UNUSUAL", "info"),
        flag(issue > as_of, "ISSUE_DATE_FUTURE", "error"),
        flag(issue < birth, "ISSUE_BEFORE_BIRTH", "critical"),
        flag((kind == "national_id") & (age_at_issue >= 0) & (age_at_issue < 14), "ISSUED_TO_MINOR", "info"),
        flag(F.col("photo_present") & (F.col("photo_gender") != gender), "PHOTO_GENDER_HEURISTIC_MISMATCH", "info"),
        flag(~no_text("full_name_ar") & (F.size(_parts("full_name_ar")) < 2), "ARABIC_NAME_TOO_SHORT", "warning"),
        flag(~no_text("full_name_en") & (F.size(_parts("full_name_en")) < 2), "ENGLISH_NAME_TOO_SHORT", "warning"),
        flag(no_text("national_id") | (no_text("full_name_ar") & no_text("full_name_en")) | no_text("birth_date"), "MISSING_REQUIRED_FIELD", "error"),
        flag(F.exists(F.array("birth_date", "expiry_date", "issue_date"), lambda d: (F.trim(d) != "") & ~d.rlike(iso)), "DATE_FORMAT_NON_ISO", "warning"),
        flag(F.lower(gender).rlike("other|non.?binary|unspecified|^x$"), "GENDER_OTHER_ACCEPTED", "info"),
        flag((F.trim(gender) != "") & ~F.lower(gender).isin("male", "female", "m", "f") & ~F.lower(gender).rlike("other|non.?binary|unspecified|^x$"), "GENDER_UNRECOGNIZED", "warning"),
        flag(F.col("document_no").isNotNull() & ~F.regexp_replace("document_no", r"[\s-]", "").rlike("^[A-Za-z0-9]{6,14}$"), "DOCUMENT_NUMBER_FORMAT_MISMATCH", "warning"),
        flag(has_arabic("full_name_ar") & (latin_gap > 3), "CROSS_LANGUAGE_NAME_MISMATCH", "warning"),
        flag((F.datediff(as_of, issue) <= 30) & (expiry < as_of), "RECENTLY_ISSUED_BUT_EXPIRED", "critical"),
        flag(F.datediff(mrz_expiry, as_of) < -grace_days, "MRZ_EXPIRY_PAST_GRACE", "error"),
        flag(F.datediff(mrz_expiry, as_of).between(-grace_days, -1), "MRZ_EXPIRY_RECENTLY_EXPIRED", "info"),
        flag(reduce(lambda c, kv: c.when(country == kv[0], parts < kv[1][0]), NAME_PARTS.items(), F.when(F.lit(False), False)) & (parts > 0), "NAME_TOO_SHORT_FOR_COUNTRY", "warning"),
        flag(reduce(lambda c, kv: c.when(country == kv[0], parts > kv[1][1]), NAME_PARTS.items(), F.when(F.lit(False), False)), "NAME_TOO_LONG_FOR_COUNTRY", "info"),
        *[flag((country == cc) & long_address & ~address.rlike(pattern), code, "info") for cc, (pattern, code) in ADDRESS_PATTERNS.items()],
        flag(arabic_home & long_address & ~has_arabic("address"), "ADDRESS_FORMAT_AR_NO_ARABIC", "info"),
        flag(country.isin("IR", "AF") & long_address & ~has_arabic("address"), "ADDRESS_FORMAT_IR_NO_PERSIAN", "info"),
        flag(~F.col("photo_present"), "PHOTO_MISSING", "error"),
        flag((kind == "passport") & (since_issue > 15), "DOCUMENT_AGE_PASSPORT_TOO_OLD", "warning"),
        flag((kind != "passport") & country.isin(*INDEFINITE_COUNTRIES) & (since_issue > 50), "DOCUMENT_AGE_INDEFINITE_TOO_OLD", "warning"),
        flag((kind != "passport") & ~country.isin(*INDEFINITE_COUNTRIES) & (since_issue > 15), "DOCUMENT_AGE_EXPIRED_BY_REISSUANCE", "warning"),
        flag((F.col("biometric_variance") < 0) | (F.col("biometric_variance") > 1), "BIOMETRIC_VARIANCE_OUT_OF_RANGE", "warning"),
        flag(F.col("biometric_variance").between(0.5, 1.0), "BIOMETRIC_VARIANCE_HIGH_DIFFERENT_PERSON", "critical"),
        flag((F.col("biometric_variance") >= 0.3) & (F.col("biometric_variance") < 0.5), "BIOMETRIC_VARIANCE_SUSPICIOUS", "warning"),
        flag(any_other(lambda o: (F.left(o["birth_date"], F.lit(4)) == F.left(mine["birth_date"], F.lit(4))) & (o["birth_date"] != mine["birth_date"])), "CROSS_DOC_BIRTHDATE_DAY_MISMATCH", "warning"),
        flag(any_other(lambda o: F.left(o["birth_date"], F.lit(4)) != F.left(mine["birth_date"], F.lit(4))), "CROSS_DOC_BIRTHDATE_MISMATCH", "error"),
        flag(any_other(lambda o: both(o["full_name_en"], en) & (shared(o["full_name_en"], en) == 0)), "CROSS_DOC_NAME_MISMATCH", "error"),
        flag(any_other(lambda o: both(o["full_name_en"], en) & (shared(o["full_name_en"], en) == 1) & (F.size(_words(en)) >= 2) & (F.size(_words(o["full_name_en"])) >= 2)), "CROSS_DOC_NAME_PARTIAL_MATCH", "info"),
        flag(any_other(lambda o: both(o["full_name_ar"], ar) & (shared(o["full_name_ar"], ar) == 0)), "CROSS_DOC_ARABIC_NAME_MISMATCH", "warning"),
        flag(any_other(lambda o: o["gender"] != gender), "CROSS_DOC_GENDER_MISMATCH", "critical"),
        flag(country.isin(*ADULT_ID_COUNTRIES) & (age > 0) & (age < 16), "AGE_GENDER_MINOR_ID", "info"),
        flag(arabic_home & no_text("full_name_ar") & ~has_arabic(F.coalesce(en, F.lit(""))), "NATIONALITY_LANGUAGE_ARABIC_EXPECTED", "info"),
        flag(country.isin("US", "GB", "FR", "DE") & ~has_latin(F.coalesce(en, F.lit(""))), "NATIONALITY_LANGUAGE_LATIN_EXPECTED", "info"),
    ]
    pick = lambda table, then: reduce(lambda c, kv: c.when(country == kv[0], then(kv[1])), table.items(), F.when(F.lit(False), False))
    if places:
        rules.append(flag(pick(places, lambda known: ~F.lower("issue_place").rlike("|".join(known))), "ISSUE_PLACE_UNKNOWN", "info"))
    if numbers:
        rules.append(flag(pick(numbers, lambda pattern: ~F.regexp_replace("document_no", r"[\s-]", "").rlike(pattern)), "DOCUMENT_NUMBER_FORMAT_BY_COUNTRY", "warning"))
    if names:
        rules.append(flag(F.size(F.array_except(_words("full_name_ar"), F.array(*map(F.lit, names)))) > 0, "ARABIC_NAME_NOT_IN_DICTIONARY", "info"))
    if dual:
        listed = pick(dual, lambda more: F.lower("nationality").isin(*more))
        rules.append(flag((F.upper("nationality") != country) & ~listed, "NATIONALITY_DUAL_CITIZEN_UNVERIFIED", "warning"))
        rules.append(flag((F.upper("nationality") != country) & listed, "NATIONALITY_DUAL_CITIZEN_VERIFIED", "info"))
    return flags(*rules)


def record_status(doc_confidence: Column, face_ok: Column, live_ok: Column, blocked: Column, critical: Column) -> Column:
    return F.when(blocked | critical, "rejected").when((doc_confidence >= 0.6) & face_ok & live_ok, "verified").otherwise("failed")


def adaptive_risk(duplicate: Column, reuse: Column, mismatch: Column, unknown_device: Column, script: Column) -> Column:
    points = 30 * duplicate.cast("int") + 25 * reuse.cast("int") + 15 * mismatch.cast("int") + 5 * unknown_device.cast("int") + 10 * script.cast("int")
    level = F.when(points >= 30, "high").when(points >= 10, "medium").otherwise("low")
    return F.struct(points.alias("points"), level.alias("level"), F.when(points >= 30, 3).when(points >= 10, 2).otherwise(1).alias("challenges"))


def evidence_status(evidence, live, unsupported, expired, least_live: float = 0.6) -> Column:
    """One of the decision states, by fixed priority over (check, result) items."""
    e = F.col(evidence)
    about = lambda x, *words: reduce(lambda a, b: a | b, [F.contains(x["check"], F.lit(w)) for w in words])
    structural = F.filter(e, lambda x: about(x, "structure", "MRZ", "cross_field"))
    failed = F.filter(structural, lambda x: x["result"] == "fail")
    first = lambda *words: F.try_element_at(F.filter(e, lambda x: about(x, *words)), F.lit(1))["result"]
    return (
        F.when(F.col(unsupported), "UNSUPPORTED_DOCUMENT")
        .when((F.size(failed) > 0) & F.exists(failed, lambda x: about(x, "cross_field")), "DOCUMENT_MISMATCH")
        .when(F.size(failed) > 0, "INVALID_STRUCTURE")
        .when(F.col(expired), "EXPIRED")
        .when(F.col(live) < least_live, "LIVENESS_INCONCLUSIVE")
        .when(first("chip", "electronic") == "pass", "ELECTRONIC_AUTHENTICATION_PASSED")
        .when(first("issuer", "registry") == "pass", "ISSUER_CHECK_CONFIRMED")
        .when((F.size(e) > 0) & F.forall(e, lambda x: x["result"].isin("pass", "not_performed")), "VERIFIED_WITH_SUPPORTED_EVIDENCE")
        .when((F.size(structural) > 0) & F.forall(structural, lambda x: x["result"] == "pass"), "STRUCTURE_VALID_BUT_AUTHENTICITY_UNCONFIRMED")
        .otherwise("MANUAL_REVIEW_REQUIRED")
    )


def confidence_breakdown(evidence, findings, live: Column, face: Column) -> Column:
    """Shares behind a decision: mean OCR confidence of the findings (source,
    confidence) read by OCR, 0.5 where unknown; passed structural and cross-field
    checks; chip and half of issuer checks; liveness and face match as they are."""
    e, f = F.col(evidence), F.col(findings)
    about = lambda x, *words: reduce(lambda a, b: a | b, [F.contains(x["check"], F.lit(w)) for w in words])
    some = lambda *words: F.filter(e, lambda x: about(x, *words))
    share = lambda found: F.size(F.filter(found, lambda x: x["result"] == "pass")) / F.greatest(F.size(found), F.lit(1))
    passed = lambda *words: F.coalesce(F.try_element_at(some(*words), F.lit(1))["result"] == "pass", F.lit(False)).cast("int")
    read = F.transform(F.filter(f, lambda x: x["source"] == "ocr"), lambda x: F.coalesce(F.nullif(x["confidence"], F.lit(0.0)), F.lit(0.5)))
    return F.struct(
        (F.aggregate(read, F.lit(0.0), lambda a, c: a + c) / F.greatest(F.size(read), F.lit(1))).alias("ocr"),
        share(some("structure", "MRZ", "cross_field")).alias("structural"),
        share(some("cross_field")).alias("cross_field"),
        (passed("chip", "electronic") + passed("issuer", "registry") / 2).alias("authenticity"),
        live.alias("liveness"),
        face.alias("face_match"),
    )


def risk_fusion(signals: dict[str, Column], codes: Column, critical: list[str]) -> Column:
    """Weighted mean of the signals; a critical code rejects, else by bands."""
    total = reduce(lambda a, b: a + b, [F.coalesce(signals[k], F.lit(0.0)) * w for k, w in RISK_WEIGHTS.items() if k in signals])
    score = half_up(total / sum(w for k, w in RISK_WEIGHTS.items() if k in signals), 4)
    stop = F.arrays_overlap(codes, F.array(*map(F.lit, critical)))
    return F.struct(score.alias("score"), F.when(stop, "reject").when(score >= 0.80, "approve").when(score >= 0.60, "review").otherwise("reject").alias("decision"), F.array_distinct(codes).alias("codes"))


def document_signal(confidence: Column, tampering: Column, mrz_ok: Column) -> Column:
    return F.when(tampering > 0.3, 0.0).otherwise(confidence * (1 - tampering) * F.when(mrz_ok, 1.0).otherwise(0.5))


def face_signal(similarity: Column, is_match: Column, quality: Column) -> Column:
    return F.when(is_match, F.least(F.lit(1.0), similarity * 1.2)).otherwise(similarity * 0.3) * F.when(quality < 0.4, 0.7).otherwise(1.0)


#: States of a source's lifecycle and where each may go.
LIFECYCLE = {
    "DISCOVERED": ("UNDER_REVIEW", "REJECTED", "BLOCKED"),
    "UNDER_REVIEW": ("APPROVED", "REJECTED", "RESTRICTED", "BLOCKED"),
    "APPROVED": ("DOWNLOADABLE", "RESTRICTED", "REJECTED"),
    "DOWNLOADABLE": ("DOWNLOADED", "RESTRICTED", "BLOCKED"),
    "DOWNLOADED": ("VALIDATED", "DOWNLOADABLE", "BLOCKED"),
    "VALIDATED": ("INTEGRATED", "DOWNLOADED", "BLOCKED"),
    "INTEGRATED": ("VALIDATED", "DOWNLOADED", "BLOCKED"),
    "REJECTED": ("UNDER_REVIEW", "BLOCKED"),
    "RESTRICTED": ("UNDER_REVIEW", "APPROVED", "BLOCKED"),
    "BLOCKED": (),
}


def lifecycle_violations(events: DataFrame, key: str, state: str, ts: str, order: str, allowed: dict[str, tuple[str, ...]] = LIFECYCLE) -> DataFrame:
    """Events whose state may not follow their key's last one."""
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, bs in allowed.items() for b in bs])
    w = Window.partitionBy(key).orderBy(ts, order)
    out = events.withColumn("previous", F.lag(state).over(w)).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(state)))
    return out.where(~F.array_contains(pairs, F.concat_ws(">", "previous", state)))


def first_failing(gates: list[tuple[str, Column]]) -> Column:
    """Name of the first gate that isn't passed; null if all are."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates])


def quota_level(percent: Column) -> Column:
    return F.when(percent >= 100, "exhausted").when(percent >= 95, "emergency").when(percent >= 90, "restrict").when(percent >= 80, "warning").when(percent >= 70, "monitoring").otherwise("ok")
