"""Queries over readings of documents and questions: labels, fields, intents."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import phrases, repair
from attestry.sources.tables import read

_STARTS = tuple(each[0] if isinstance(each[0], str) else each[0][0] for _, each in phrases.INTENTS) + ("security of a document", "what is")


def _pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def query_intents(spark, sf_dir):
    """Each document as a question, a third of them with a phrase in front."""
    d = read(spark, sf_dir, "documents")
    start = _pick([s.removeprefix("^") for s in _STARTS], F.col("doc_id"))
    asked = F.when(F.col("doc_id") % 3 == 0, F.concat_ws(" ", start, "text")).otherwise(F.col("text"))
    return d.select("doc_id", phrases.intent(asked).alias("intent"))


def _readings(spark, sf_dir):
    """Text as read from a customer's document; letters stand for digits in a third of the numbers."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    number = F.lpad(k.cast("string"), 9, "0")
    number = F.when(k % 3 == 0, F.translate(number, "05", "OS")).otherwise(number)
    country = F.overlay(_pick(phrases.COUNTRIES_EN, k), F.lit("x"), F.lit(2))
    english = F.concat(F.lit("Full Name: "), "c_name", F.lit("\nNational ID  "), number, F.lit(" Date of Birth:1990-01-02\nNationality\n: "), country, F.lit("\nPassport No. ab-"), k.cast("string"))
    arabic = F.concat(F.lit("الرقم القومي: "), k.cast("string"), F.lit(" الجنسية مصر"))
    return c.select("c_custkey", F.when(k % 7 == 0, arabic).alias("arabic"), english.alias("english"))


def extracted_fields(spark, sf_dir):
    return phrases.extracted(_readings(spark, sf_dir), "c_custkey", "arabic", "english")


def processed_fields(spark, sf_dir):
    found = phrases.extracted(_readings(spark, sf_dir), "c_custkey", "arabic", "english")
    none = spark.createDataFrame([("John",), ("Smith",)], "entry string")
    out = phrases.processed(found, "c_custkey", none.where("false"), none)
    return out.select("c_custkey", "field", "corrected", "changed", F.array_join("steps", ",").alias("steps"))


def corrected_numbers(spark, sf_dir):
    """Fourteen digits, one too few, one too many, or a passport with letters for digits."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    whole = F.concat(F.lit("2"), two(k % 100), two(k % 12 + 1), two(k % 28 + 1), two(k % 35 + 1), F.lpad((k * 7919 % 99991).cast("string"), 5, "0"))
    passport = F.concat(F.lit("AB"), F.translate(F.lpad((k * 31 % 999983).cast("string"), 6, "0"), "0158", "OISB"))
    less, more = F.concat(F.substring(whole, 1, 9), F.substring(whole, 11, 9)), F.concat(F.substring(whole, 1, 6), F.lit("4"), F.substring(whole, 7, 9))
    raw = F.when(k % 4 == 0, whole).when(k % 4 == 1, less).when(k % 4 == 2, more).otherwise(passport)
    return c.select("c_custkey", repair.corrected(raw, F.lit("EG")).alias("number"))


def cheapest_readings(spark, sf_dir):
    """Nine digits with look-alikes, by Luhn's sum."""
    k = F.col("c_custkey")
    base = F.lpad((k * 7919 % 999999937).cast("string"), 9, "0")
    raw = F.when(k % 2 == 0, F.translate(base, "0158", "OISB")).otherwise(base)
    return repair.by_check_digit(read(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")), "c_custkey", "raw", repair.luhn(9), 10)


def _sql_case() -> str:
    quote = lambda p: p.replace("'", "''")
    test = lambda p: f"starts_with(q, '{quote(p[1:])}')" if p[0] == "^" else f"contains(q, '{quote(p)}')"
    lines = [f"when {' or '.join(test(e) if isinstance(e, str) else '(' + ' and '.join(map(test, e)) + ')' for e in each)} then '{name}'" for name, each in phrases.INTENTS]
    return "case " + " ".join(lines) + " else 'default' end"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_COUNTRY = f"{_list(phrases.COUNTRIES_EN)}[c_custkey % 30 + 1]"
_FIELDS = f"""k as (select c_custkey, c_name, lpad(c_custkey::varchar, 9, '0') n, c_custkey % 7 = 0 ar, c_custkey % 3 = 0 odd, left({_COUNTRY}, 1) || 'x' || substr({_COUNTRY}, 3) y from customer),
x as (select c_custkey, 'fullNameEn' field, c_name as value, 'Full Name' as label from k
union all select c_custkey, 'nationalId', case when ar then c_custkey::varchar when odd then translate(n, '05', 'OS') else n end, case when ar then 'الرقم القومي' else 'National ID' end from k
union all select c_custkey, 'birthDate', '1990-01-02', 'Date of Birth' from k
union all select c_custkey, 'nationality', case when ar then 'مصر' else y end, case when ar then 'الجنسية' else 'Nationality' end from k
union all select c_custkey, 'gender', 'ية مصر', 'الجنس' from k where ar -- a label within another one
union all select c_custkey, 'documentNo', 'ab-' || c_custkey, 'Passport No.' from k)"""
QUERIES = {
    "query_intents": (
        query_intents,
        f"""with a as (select doc_id, lower(trim(case when doc_id % 3 = 0 then concat_ws(' ', {_list([s.removeprefix('^') for s in _STARTS])}[doc_id % {len(_STARTS)} + 1], text) else coalesce(text, '') end, ' ')) q from documents)
        select doc_id, {_sql_case()} intent from a""",
    ),
    "extracted_fields": (extracted_fields, f"with {_FIELDS} select * from x"),
    "processed_fields": (
        processed_fields,
        f"""with {_FIELDS}, d as (select unnest({_list(phrases.COUNTRIES_EN)}) e, unnest(range(30)) i),
        f as (select value w, arg_min(e, (levenshtein(value, e), i)) e from (select distinct value from x where field = 'nationality'), d where levenshtein(value, e) <= 3 group by 1),
        r as (select x.*, case when field in ('nationalId', 'documentNo') then value when field = 'gender' then translate(value, 'ةىؤئ', 'هيوي') else replace(replace(replace(replace(replace(value, 'rn', 'm'), 'vv', 'w'), 'cl', 'd'), 'IJ', 'U'), 'ni', 'm') end z from x),
        c as (select r.*, case field when 'nationalId' then translate(z, 'OS', '05') when 'documentNo' then upper(replace(z, '-', '')) when 'nationality' then coalesce((select e from f where f.w = z), (select arg_min(e, (levenshtein(z, e), i)) from d where levenshtein(z, e) <= 3), z) else z end corrected from r)
        select c_custkey, field, corrected, corrected <> value as changed, concat_ws(',', case when z <> value then 'confusions' end, case when corrected <> z then case when field = 'nationality' then 'country' else 'number' end end) steps from c""",
    ),
    "corrected_numbers": (
        corrected_numbers,
        """with w as (select c_custkey k, '2' || lpad((c_custkey % 100)::varchar, 2, '0') || lpad((c_custkey % 12 + 1)::varchar, 2, '0') || lpad((c_custkey % 28 + 1)::varchar, 2, '0') || lpad((c_custkey % 35 + 1)::varchar, 2, '0') || lpad((c_custkey * 7919 % 99991)::varchar, 5, '0') s from customer),
        r as (select k, case k % 4 when 0 then s when 1 then substr(s, 1, 9) || substr(s, 11) when 2 then substr(s, 1, 6) || '4' || substr(s, 7) else 'AB' || translate(lpad((k * 31 % 999983)::varchar, 6, '0'), '0158', 'OISB') end t from w),
        c as (select k, t, d * 100 + i o, left(t, i) || d || substr(t, i + 1) x from r, (select unnest(range(10)) d), (select unnest(range(14)) i) where k % 4 = 1 union all select k, t, i, left(t, i) || substr(t, i + 2) from r, (select unnest(range(15)) i) where k % 4 = 2),
        f as (select *, (select sum(substr(x, p, 1)::int * p) % 11 from (select unnest(range(1, 14)) p)) m from c where regexp_matches(x, '^[23]') and substr(x, 4, 2)::int between 1 and 12 and substr(x, 6, 2)::int between 1 and 31 and substr(x, 8, 2)::int between 1 and 88),
        g as (select k, coalesce(arg_min(x, o) filter ((11 - m) % 11 = substr(x, 14, 1)::int or m = substr(x, 14, 1)::int), arg_min(x, o)) x from f group by 1)
        select r.k c_custkey, case k % 4 when 0 then t when 3 then 'AB' || translate(substr(t, 3), 'OISB', '0158') else coalesce(x, t) end number from r left join g using (k)""",
    ),
    "cheapest_readings": (cheapest_readings, None),
}
