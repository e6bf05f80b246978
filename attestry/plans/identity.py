"""Queries over identity fields: checksums, zones, names, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import checksums, mrz, text
from attestry.operators import consensus, rules, series
from attestry.plans.common import SIGNALS_SQL, signals
from attestry.sources.generators import zones
from attestry.sources.tables import read

#: Length of an ID, and the letters it takes, for each country shown.
SHAPES = {
    "EG": 14, "SA": 10, "AE": 15, "IL": 9, "TR": 11, "FR": 15, "PT": 9, "BR": 11, "NL": 9, "BE": 11, "SE": 10, "NO": 11, "US": 9, "IN": 12, "ZA": 13, "PK": 13, "PL": 11, "CZ": 10, "RO": 13,
    "DK": 10, "HR": 11, "RS": 13, "BG": 10, "SK": 11, "EE": 11, "LV": 11, "LT": 11, "SI": 13, "IS": 10, "RU": 12, "CH": 13, "AT": 9, "AR": 8, "CO": 10, "AU": 9, "CA": 9, "JP": 12, "KR": 13,
    "TH": 13, "ID": 16, "PH": 12, "MY": 12, "VN": 12, "BD": 10, "LK": 12, "NP": 11, "AF": 10, "IR": 10, "IQ": 12, "LB": 12, "PS": 9, "SD": 11, "LY": 12, "YE": 10, "DZ": 18, "TN": 8, "BH": 9,
    "KW": 12, "MA": 18, "NG": 11, "KH": 9, "MX": 18, "DE": 11, "HU": 11,
}


def _id_of(n: int) -> str:
    """An ID of n digits from a customer's key; plain SQL in both engines."""
    return f"lpad(cast(c_custkey * 7919 % 999983 as varchar(20)) || cast(c_custkey * 104729 % 999979 as varchar(20)) || cast(c_custkey * 1299709 % 999961 as varchar(20)), {n}, '{'12345678901234567890'[:n]}')"


_LETTERS, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ANY = _DIGITS + _LETTERS

#: For countries whose IDs hold letters or separators, what each place of an ID can be.
PLACES = {
    "CL": [*[_DIGITS] * 8, "-", _DIGITS + "k"],
    "ES": [_DIGITS + "XYZ", *[_DIGITS] * 7, " ", _LETTERS],
    "FI": ["0123", _DIGITS, "01", *[_DIGITS] * 3, "A012", *[_DIGITS] * 3, _ANY],
    "GB": ["ABCEGHJKLMNOPRSTWXYZD", "ABCEGHJKLMNOPRSTWXYZQ", " ", *[_DIGITS] * 6, "ABCDE"],
    "GH": [*[_LETTERS] * 3, "-", *[_DIGITS] * 8, _ANY],
    "GR": [_LETTERS, _LETTERS + "0", "-", *[_DIGITS] * 6],
    "HK": [_LETTERS, _LETTERS + _DIGITS, *[_DIGITS] * 5, "(", _DIGITS + "A", ")"],
    "IE": [*[_DIGITS] * 7, _LETTERS, "AB "],
    "IT": [*[_LETTERS] * 6, *[_DIGITS] * 2, "ABCDEHLMPRST", *[_DIGITS] * 2, _LETTERS, *[_DIGITS] * 3, _LETTERS],
    "MU": [_LETTERS + "0", *[_DIGITS] * 12, _ANY],
    "SG": ["STFGM", *[_DIGITS] * 7, _LETTERS.lower()],
}


def _id_from(places: list[str]) -> str:
    """An ID from a customer's key, place by place; plain SQL in both engines."""
    return "(" + " || ".join(f"substr('{p}', cast((c_custkey + {i + 1}) * {7919 + 104729 * i} % 999983 % {len(p)} as int) + 1, 1)" for i, p in enumerate(places)) + ")"


def _id_in(country: str) -> str:
    return _id_from(PLACES[country]) if country in PLACES else _id_of(SHAPES[country])


def id_validity(spark, sf_dir):
    """Valid IDs and checksums by country, over IDs made from customer keys, in one scan."""
    each = [F.struct(F.lit(cc).alias("country"), checksums.judged(cc, _id_in(cc)).alias("r")) for cc in checksums.RULES]
    # The keys are few bytes and the rules are much work, so the keys are dealt out first.
    keys = read(spark, sf_dir, "customer").select("c_custkey").repartition(spark.sparkContext.defaultParallelism)
    rows = keys.select(F.inline(F.array(*each)))
    return rows.groupBy("country").agg(F.count_if("r.is_valid").alias("valid"), F.count_if("r.checksum_valid").alias("checked"), F.sum("r.birth_year").alias("years"), F.count_if(F.col("r.sex") == "Male").alias("male"))


#: Published specimens, valid by their issuers' own rules, and the same with a wrong last character.
SPECIMENS = (
    ("BR", "52998224725", "52998224726"),
    ("PL", "44051401359", "44051401350"),
    ("NL", "111222333", "111222334"),
    ("FR", "255081416802538", "255081416802539"),
    ("ES", "12345678Z", "12345678A"),
    ("ES", "X1234567L", "X1234567A"),
    ("HR", "94577403194", "94577403195"),
    ("EE", "37605030299", "37605030290"),
    ("SE", "8112189876", "8112189877"),
    ("NO", "29029600013", "29029600014"),
    ("CZ", "7103192745", "7103192746"),
    ("RO", "1800101221144", "1800101221145"),
    ("BG", "7523169263", "7523169264"),
    ("ZA", "8001015009087", "8001015009088"),
    ("IN", "999941057058", "999941057059"),
    ("CL", "76086428-5", "76086428-6"),
    ("SG", "S1234567D", "S1234567A"),
    ("IL", "123456782", "123456783"),
    ("CA", "046454286", "046454287"),
    ("PT", "123456789", "123456780"),
    ("AU", "123456782", "123456783"),
    ("JP", "123456789018", "123456789019"),
    ("RS", "0101006500006", "0101006500007"),
    ("LT", "33309240064", "33309240065"),
    ("IR", "0084575948", "0084575949"),
    ("RU", "500100732259", "500100732250"),
)


def specimen_ids(spark, sf_dir):
    """Each customer with a published specimen, as it is or with another check digit, and the verdict of its country's rule."""
    k = F.col("c_custkey")
    pair = F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in SPECIMENS]), (F.floor(k / 2) % len(SPECIMENS) + 1).cast("int"))
    rows = read(spark, sf_dir, "customer").select("c_custkey", pair[0].alias("country"), F.when(k % 2 == 0, pair[1]).otherwise(pair[2]).alias("id"))
    return checksums.validate(rows).select("c_custkey", "country", "id", "checksum_valid")


def _id_sql() -> str:
    parts = []
    for cc in checksums.RULES:
        r = checksums.rule_sql(cc, "c", duckdb=True)
        clean = checksums.cleaned_sql(checksums.RULES[cc], _id_in(cc), duckdb=True)
        parts.append(
            f"select '{cc}' country, count(*) filter ({r['valid']}) valid, count(*) filter ({r['checksum']}) checked, cast(sum(cast({r['year']} as bigint)) as bigint) as years, count(*) filter (coalesce(cast({r['male']} as boolean), false)) male from (select {clean} c from customer)"
        )
    return " union all ".join(parts)


def luhn_validity(spark, sf_dir):
    """Customer keys padded to nine digits: digit sum with even places doubled."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("raw"))
    return c.select("c_custkey", checksums.validated("CA", "raw")["checksum_valid"].alias("ok"))


def verhoeff_validity(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("9"), F.lpad(F.col("o_orderkey").cast("string"), 11, "0")).alias("raw"))
    return o.where(checksums.validated("IN", "raw")["checksum_valid"]).select("o_orderkey")


def icao_check_digit(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", mrz.check_digit(F.upper(F.regexp_replace("p_name", "[^A-Za-z0-9]", "<"))).cast("long").alias("digit"))


def _people(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("NAME"), F.translate(F.col("c_nationkey").cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit(" SUR"), F.translate((F.col("c_custkey") % 1000).cast("string"), "0123456789", "ABCDEFGHIJ")).alias("full_name_en"),
        F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") * 37 % 20000).cast("int")).alias("birth_date"),
        F.when(F.col("c_custkey") % 2 == 0, "Male").otherwise("Female").alias("gender"),
        F.date_add(F.lit("2026-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int")).alias("expiry_date"),
        F.concat(F.lit("D"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("document_no"),
    )


def mrz_roundtrip(spark, sf_dir):
    """Zones built from customers, every seventh with a wrong digit, parsed back."""
    z = zones(_people(spark, sf_dir), corrupt_every=7).withColumn("m", mrz.parse(F.col("mrz_text")))
    return z.select("id", F.col("m.number").alias("number"), F.col("m.birth_date").alias("birth_date"), F.col("m.sex").alias("sex"), F.col("m.surname").alias("surname"), F.col("m.given").alias("given"), F.col("m.valid").alias("valid"))


def canonicalize_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.canonical("text")).alias("digest"))


def sanitized(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.sanitize("text")).alias("digest"), text.masked(F.col("source")).alias("masked"))


def field_match(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    other = F.when(F.col("p_partkey") % 3 == 0, F.reverse("p_type")).when(F.col("p_partkey") % 3 == 1, F.concat("p_type", F.lit("x"))).otherwise(F.upper("p_type"))
    return p.select("p_partkey", text.field_matches("p_type", other).alias("ok"))


def string_similarity(spark, sf_dir):
    a = read(spark, sf_dir, "nation")
    b = a.select(F.col("n_nationkey").alias("other"), F.col("n_name").alias("other_name"), F.col("n_regionkey").alias("r"))
    pairs = a.join(b, (F.col("n_regionkey") == F.col("r")) & (F.col("n_nationkey") < F.col("other")))
    return pairs.select("n_nationkey", "other", F.round(text.similarity("n_name", "other_name"), 6).alias("similarity"))


def nearest_dictionary(spark, sf_dir):
    words = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.element_at(F.split("p_type", " "), -1), F.when(F.col("p_partkey") % 4 == 0, "X").otherwise("")).alias("word"))
    entries = read(spark, sf_dir, "part").select(F.element_at(F.split("p_type", " "), -1).alias("entry"))
    return consensus.nearest(words, "word", entries, "entry").select("p_partkey", "nearest", F.col("edits").cast("long").alias("edits"))


def duplicate_ids(spark, sf_dir):
    """How many earlier events came from the same hub."""
    out = series.seen_before(signals(spark, sf_dir), "k", "ts", "event_id")
    return out.select("event_id", F.col("earlier").cast("long").alias("earlier"))


def content_reuse(spark, sf_dir):
    """Documents whose text was seen before, by hash."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 32).alias("h"))
    return series.seen_before(d, "h", "doc_id", "doc_id").where("earlier > 0").select("doc_id", F.col("earlier").cast("long").alias("earlier"))


def fraud_score(spark, sf_dir):
    """Flags of users from velocity, errors and values, and their score."""
    u = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("top"))
    found = rules.flags(rules.flag(F.col("errors") > 16, "ERRORS", "critical"), rules.flag(F.col("n") > 60, "VELOCITY", "warning"), rules.flag(F.col("top") > 250, "VALUE", "warning"), rules.flag(F.col("top") < 150, "LOW", "info"))
    out = u.select("user_id", rules.fraud(found).alias("f"), F.array_join(F.transform(found, lambda x: x["code"]), ",").alias("codes"))
    return out.select("user_id", "f.risk", F.col("f.score").cast("long").alias("score"), "codes")


def risk_adaptive(spark, sf_dir):
    u = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    r = rules.adaptive_risk(F.col("n") > 70, F.col("top") > 300, F.col("user_id") % 3 == 0, F.col("user_id") % 5 == 0, F.col("user_id") % 7 == 0)
    return u.select("user_id", r["points"].cast("long").alias("points"), r["level"].alias("level"), r["challenges"].cast("long").alias("challenges"))


def blacklist(spark, sf_dir):
    return read(spark, sf_dir, "part").where(rules.blacklisted("p_name", ["7", "Part 1"])).select("p_partkey")


#: What the rules by country are given here: issuing places, numbers, name parts and second nationalities of one country.
_CROSS_TABLES = {"places": {"EG": ["cairo", "giza", "alexandria"]}, "numbers": {"EG": "^[A-Za-z][0-9]{7,8}$"}, "names": ["محمد", "أحمد", "علي", "حسن"], "dual": {"EG": ["us", "gb", "ca"]}}


def cross_field(spark, sf_dir):
    """All cross-field flags over records made from customers, with their score."""
    p = zones(_people(spark, sf_dir), corrupt_every=7)
    nid = F.lpad(F.col("id").cast("string"), 14, "29001011200000")
    rec = p.select(
        "id", F.when(F.col("id") % 9 == 4, "محمد سمسمية").alias("full_name_ar"), "full_name_en", nid.alias("national_id"), F.lit("EG").alias("country"), F.col("birth_date").cast("string").alias("birth_date"), "gender",
        F.col("expiry_date").cast("string").alias("expiry_date"), F.date_sub("expiry_date", 3650).cast("string").alias("issue_date"), F.when(F.col("id") % 10 == 0, "US").when(F.col("id") % 10 == 5, "FR").otherwise("EG").alias("nationality"),
        "document_no", F.when(F.col("id") % 2 == 0, "passport").otherwise("national_id").alias("doc_type"), (F.col("id") % 11 != 0).alias("photo_present"), F.lit(None).cast("string").alias("photo_gender"),
        (F.col("id") % 100 / 100).alias("biometric_variance"), F.lit("1 Main Street 12345").alias("address"), F.when(F.col("id") % 8 == 3, "Atlantis").otherwise("Cairo").alias("issue_place"),
        F.when(F.col("id") % 13 == 0, F.array(F.struct(F.lit("1990-01-01").alias("birth_date"), F.lit("OTHER PERSON").alias("full_name_en"), F.lit(None).cast("string").alias("full_name_ar"), F.col("gender")))).alias("other_documents"), mrz.parse(F.col("mrz_text")).alias("mrz"),
    )
    cols = checksums.validated("EG", "national_id")
    rec = rec.withColumn("id_", F.struct(*[c.alias(k) for k, c in cols.items()]))
    rec = rec.withColumnsRenamed({"id": "key", "id_": "id"})
    found = rec.withColumn("flags", rules.cross_field(F.lit("2025-06-01").cast("date"), **_CROSS_TABLES)).select("key", rules.validation(F.col("flags")).alias("v"))
    return found.select("key", "v.score", "v.fraud_probability", "v.has_critical", "v.has_errors", F.array_join("v.codes", ",").alias("codes"))


def consensus_vote(spark, sf_dir):
    return consensus.vote(read(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", "winner", F.round("share", 6).alias("share"))


def consensus_majority(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("high", F.col("value") > 35)
    return consensus.majority(e, "user_id", "high")


def consensus_numeric(spark, sf_dir):
    return consensus.numeric(read(spark, sf_dir, "events"), "user_id", "value").select("user_id", "mean", F.round("agreement", 6).alias("agreement"))


def _readings(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    each = F.explode(F.array(F.struct(F.lit(1).alias("source"), F.col("p_type").alias("said")), F.struct(F.lit(2).alias("source"), F.lower("p_type").alias("said")), F.struct(F.lit(3).alias("source"), F.concat("p_type", F.lit("Z")).alias("said")), F.struct(F.lit(4).alias("source"), F.reverse("p_type").alias("said"))))
    return p.select("p_partkey", each.alias("r")).select("p_partkey", "r.source", "r.said")


def consensus_reading(spark, sf_dir):
    return consensus.most_alike(_readings(spark, sf_dir), "p_partkey", "source", "said").select("p_partkey", F.col("source").cast("long").alias("source"), F.round("alike", 6).alias("alike"))


def consensus_string(spark, sf_dir):
    return consensus.clusters(_readings(spark, sf_dir), "p_partkey", "source", "said")


QUERIES = {
    "id_validity": (id_validity, _id_sql()),
    "specimen_ids": (
        specimen_ids,
        f"""with s as (select {[list(x) for x in SPECIMENS]} s)
        select c_custkey, s[c_custkey // 2 % {len(SPECIMENS)} + 1][1] country, s[c_custkey // 2 % {len(SPECIMENS)} + 1][2 + c_custkey % 2] id, c_custkey % 2 = 0 checksum_valid from customer, s""",
    ),
    "luhn_validity": (
        luhn_validity,
        "select c_custkey, list_sum(list_transform(range(1, 10), lambda i: case when i % 2 = 0 then (case when substr(lpad(c_custkey::varchar, 9, '0'), i, 1)::int > 4 then substr(lpad(c_custkey::varchar, 9, '0'), i, 1)::int * 2 - 9 else substr(lpad(c_custkey::varchar, 9, '0'), i, 1)::int * 2 end) else substr(lpad(c_custkey::varchar, 9, '0'), i, 1)::int end)) % 10 = 0 ok from customer",
    ),
    "verhoeff_validity": (verhoeff_validity, f"select o_orderkey from (select o_orderkey, '9' || lpad(o_orderkey::varchar, 11, '0') c from orders) where {checksums.rule_sql('IN', 'c', duckdb=True)['checksum']}"),
    "icao_check_digit": (
        icao_check_digit,
        "with t as (select p_partkey, upper(regexp_replace(p_name, '[^A-Za-z0-9]', '<', 'g')) s from part) select p_partkey, (list_sum(list_transform(range(1, len(s) + 1), lambda i: greatest(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(s, i, 1)) - 1, 0) * (case i % 3 when 1 then 7 when 2 then 3 else 1 end))) % 10)::bigint digit from t",
    ),
    "mrz_roundtrip": (
        mrz_roundtrip,
        """with p as (select c_custkey id, 'NAME' || translate(c_nationkey::varchar, '0123456789', 'ABCDEFGHIJ') given, 'SUR' || translate((c_custkey % 1000)::varchar, '0123456789', 'ABCDEFGHIJ') surname, date '1950-01-01' + (c_custkey * 37 % 20000)::int b from customer)
        select id, 'D' || lpad(id::varchar, 8, '0') number, strftime(case when year(b) % 100 > 30 then b else b end, '%Y-%m-%d') birth_date, case when id % 2 = 0 then 'Male' else 'Female' end sex, surname, given, id % 7 <> 0 valid from p""",
    ),
    "canonicalize_text": (canonicalize_text, r"select doc_id, md5(regexp_replace(lower(translate(regexp_replace(text, '[ً-ْٰـ]', '', 'g'), 'آأإٱىة٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', 'اااايه01234567890123456789')), '[^\p{L}\p{N}]', '', 'g')) digest from documents"),
    "sanitized": (sanitized, r"select doc_id, md5(nullif(trim(substr(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), 1, 500), ' '), '')) digest, repeat('*', len(source)) masked from documents"),
    "field_match": (
        field_match,
        r"""with t as (select p_partkey, lower(regexp_replace(p_type, '[^\p{L}\p{N}]', '', 'g')) e, lower(regexp_replace(case p_partkey % 3 when 0 then reverse(p_type) when 1 then p_type || 'x' else upper(p_type) end, '[^\p{L}\p{N}]', '', 'g')) a from part)
        select p_partkey, e = a or contains(e, a) or contains(a, e) or levenshtein(e, a) <= (case when greatest(len(e), len(a)) <= 4 then 1 when greatest(len(e), len(a)) <= 10 then 2 else 3 end) ok from t""",
    ),
    "string_similarity": (string_similarity, "select a.n_nationkey, b.n_nationkey other, round(1 - levenshtein(lower(a.n_name), lower(b.n_name))::double / greatest(len(a.n_name), len(b.n_name)), 6) similarity from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey"),
    "nearest_dictionary": (
        nearest_dictionary,
        """with e as (select distinct split_part(p_type, ' ', -1) e from part), w as (select p_partkey, split_part(p_type, ' ', -1) || case when p_partkey % 4 = 0 then 'X' else '' end w from part),
        d as (select w, min((levenshtein(w, e), e)) b from (select distinct w from w), e where levenshtein(w, e) <= 2 group by w) select p_partkey, b[2] nearest, b[1]::bigint edits from w left join d using (w)""",
    ),
    "duplicate_ids": (duplicate_ids, f"with {SIGNALS_SQL} select event_id, case when k is null then 0 else row_number() over (partition by k order by ts, event_id) - 1 end earlier from signals"),
    "content_reuse": (content_reuse, "select doc_id, earlier from (select doc_id, row_number() over (partition by text order by doc_id) - 1 earlier from documents) where earlier > 0"),
    "fraud_score": (
        fraud_score,
        """with u as (select user_id, count(*) n, count(*) filter (event_type = 'error') errors, max(value) top from events group by 1),
        f as (select *, (errors > 16)::int c, (n > 60)::int + (top > 250)::int w, (top < 150)::int i from u)
        select user_id, case when c > 0 then 'blocked' when w > 0 then 'medium' else 'low' end risk, (case when c > 0 then greatest(0, 100 - 40 * c - 15 * w) when w > 0 then greatest(20, 100 - 20 * w - 5 * i) else greatest(60, 100 - 5 * i) end)::bigint score,
        concat_ws(',', case when errors > 16 then 'ERRORS' end, case when n > 60 then 'VELOCITY' end, case when top > 250 then 'VALUE' end, case when top < 150 then 'LOW' end) codes from f""",
    ),
    "risk_adaptive": (
        risk_adaptive,
        """with p as (select user_id, (30 * (count(*) > 70)::int + 25 * (max(value) > 300)::int + 15 * (user_id % 3 = 0)::int + 5 * (user_id % 5 = 0)::int + 10 * (user_id % 7 = 0)::int)::bigint points from events group by user_id)
        select user_id, points, case when points >= 30 then 'high' when points >= 10 then 'medium' else 'low' end as level, (case when points >= 30 then 3 when points >= 10 then 2 else 1 end)::bigint challenges from p""",
    ),
    "blacklist": (blacklist, "select p_partkey from part where contains(lower(trim(p_name)), '7') or contains(lower(trim(p_name)), 'part 1')"),
    "cross_field": (cross_field, None),
    "consensus_vote": (consensus_vote, "with c as (select user_id, event_type, count(*) n from events group by 1, 2) select user_id, event_type winner, round(share, 6) share from (select *, n::double / sum(n) over (partition by user_id) share, row_number() over (partition by user_id order by n desc, event_type) r from c) where r = 1"),
    "consensus_majority": (consensus_majority, "select user_id, count(*) filter (value > 35) * 2 > count(value) majority from events group by 1"),
    "consensus_numeric": (consensus_numeric, "select user_id, floor(avg(value) * 1000.0::double + 0.5) / 1000.0::double mean, round(1 - coalesce(stddev_pop(value), 0) / greatest(1.0::double, max(value) - min(value)), 6) agreement from events group by 1"),
    "consensus_reading": (
        consensus_reading,
        """with r as (select p_partkey, unnest([1, 2, 3, 4]) source, unnest([p_type, lower(p_type), p_type || 'Z', reverse(p_type)]) said from part),
        s as (select a.p_partkey, a.source, avg(1 - levenshtein(lower(a.said), lower(b.said))::double / greatest(len(a.said), len(b.said))) alike from r a join r b on a.p_partkey = b.p_partkey and a.source <> b.source group by 1, 2)
        select p_partkey, source::bigint source, round(alike, 6) alike from (select *, row_number() over (partition by p_partkey order by round(alike, 9) desc, source) i from s) where i = 1""",
    ),
    "consensus_string": (consensus_string, None),
}
