"""Records built from verifications: decoded IDs, graphs, log entries, quality,
corrected names and written reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.numbers import bound, clamp, half_up
from attestry.functions.text import ALEF_VARIANTS, digits_only, masked
from attestry.operators.consensus import nearest
from attestry.operators.risk import severity

#: Weights of the second check of Egyptian IDs.
EGYPT_WEIGHTS = (2, 7, 6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
#: Shares of the thirteen dimensions of a face image's quality.
FACE_QUALITY = {
    "brightness": 0.08, "contrast": 0.08, "sharpness": 0.18, "face_size": 0.15, "background": 0.08, "pose": 0.12, "occlusion": 0.10, "lighting": 0.05,
    "color": 0.05, "simplicity": 0.03, "symmetry": 0.03, "defocus": 0.03, "motion": 0.02,
}
#: Shares of the five dimensions of the older score.
FACE_OVERALL = {"brightness": 0.15, "contrast": 0.15, "sharpness": 0.30, "face_size": 0.25, "background": 0.15}


def egyptian_record(raw) -> Column:
    """Birth date, sex, governorate and check of a 14-digit Egyptian ID.

    Null unless there are 14 digits.  With an unknown century or an impossible
    month or day only ``is_valid`` (false) is set.  The check is the one of the
    document reader, which differs from the registry's in ``checksums``.
    """

    def decoded(d: Column) -> Column:
        n = lambda i, size=1: F.substring(d, i + 1, size).cast("long")
        known = n(0).isin(2, 3) & n(3, 2).between(1, 12) & n(5, 2).between(1, 31)
        year = F.when(n(0) == 2, 1900).otherwise(2000) + n(1, 2)
        total = reduce(lambda a, b: a + b, [n(i) * w for i, w in enumerate(EGYPT_WEIGHTS)])
        check = (11 - total % 11) % 10 == n(13)
        found = {
            "year": year,
            "month": n(3, 2),
            "day": n(5, 2),
            "birth_date": F.concat_ws("-", year.cast("string"), F.substring(d, 4, 2), F.substring(d, 6, 2)),
            "gender": F.when(n(12) % 2 == 1, "Male").otherwise("Female"),
            "governorate": n(7, 2),
            "checksum_valid": check,
        }
        return F.when(F.length(d) == 14, F.struct(*[F.when(known, c).alias(k) for k, c in found.items()], (known & check).alias("is_valid")))

    return bound(digits_only(raw), decoded)


def top_contributor(scores) -> Column:
    """The item of largest weight times score; the first one of equals."""
    ranked = F.transform(scores, lambda s, i: F.struct((s["weight"] * s["score"]).alias("by"), (-i).alias("place"), s.alias("item")))
    return F.array_max(ranked)["item"]


def diversity(rows: DataFrame, **parts: Column) -> DataFrame:
    """How many values each part takes, one row."""
    return rows.agg(*[F.count_distinct(c).alias(name) for name, c in parts.items()])


def graph_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of verifications (``id``, ``user_id``, ``name_en``,
    ``name_ar``, ``national_id``, ``doc_type``, ``document_no``, ``country``,
    ``created_at``, ``updated_at``).

    A person is a name with a national ID, or with the user where there is none;
    the attributes are those of its first verification.  Each verification is a
    document, linked with its person.
    """
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    name = F.coalesce(filled("name_en"), filled("name_ar"), F.lit("unknown"))
    keyed = rows.withColumn("person", F.concat(F.lit("person:"), name, F.lit("|"), F.coalesce(filled("national_id"), F.col("user_id").cast("string"))))
    document = F.concat(F.lit("doc:"), F.col("id").cast("string"))
    told = lambda **cs: F.map_from_arrays(F.array(*map(F.lit, cs)), F.array(*[c.cast("string") for c in cs.values()]))
    about = told(full_name_en=F.col("name_en"), full_name_ar=F.col("name_ar"), national_id=masked("national_id"))
    first = F.min_by(F.struct("created_at", "updated_at", about.alias("attributes")), F.struct("created_at", "id"))
    persons = keyed.groupBy(F.col("person").alias("id")).agg(first.alias("f"))
    persons = persons.select("id", F.lit("person").alias("type"), "f.attributes", F.col("f.created_at").alias("first_seen"), F.col("f.updated_at").alias("last_seen"))
    papers = keyed.select(document.alias("id"), F.lit("document").alias("type"), told(doc_type=F.col("doc_type"), document_no=F.col("document_no"), issuing_country=F.col("country")).alias("attributes"), F.col("created_at").alias("first_seen"), F.col("updated_at").alias("last_seen"))
    edges = keyed.select(document.alias("src"), F.col("person").alias("dst"), F.lit("verified_same_person").alias("type"), F.lit(1.0).alias("weight"), F.lit(1).alias("evidence"), F.col("updated_at").alias("last_seen"))
    return persons.unionByName(papers), edges


def source_entry(source: Column, at: Column, before: Column, after: Column, notes: Column | None = None) -> Column:
    """Hash of one entry of a source's log; entries are not chained.  Automatic
    entries carry no notes; elsewhere a null note counts as empty."""
    parts = [source, at, before, after] + ([] if notes is None else [notes])
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def face_quality(**dimensions: Column) -> Column:
    """``composite`` over the dimensions of FACE_QUALITY, the older ``overall``,
    and whether the image passes.  A missing dimension counts as 0."""
    given = {k: F.coalesce(dimensions.get(k, F.lit(0.0)), F.lit(0.0)) for k in FACE_QUALITY}
    total = lambda shares: reduce(lambda a, b: a + b, [given[k] * w for k, w in shares.items()])
    return bound(clamp(total(FACE_QUALITY)), lambda c: F.struct(half_up(c, 3).alias("composite"), half_up(total(FACE_OVERALL), 3).alias("overall"), (c >= 0.5).alias("pass")))


def corrected_names(rows: DataFrame, key: str, name: str, dictionary: DataFrame, entry: str, arabic: bool = False) -> DataFrame:
    """``key``, ``corrected`` and ``changed``: each word of a name replaced by the
    dictionary's, if it isn't in it.

    Arabic words first meet entries that differ only by the form of an alef, then
    the nearest within two edits; others the nearest within one.  Words of one
    letter stay.  A null or blank name stays as it is.  Only distinct words meet
    the dictionary.
    """
    words = rows.select(key, name, F.posexplode_outer(F.split(F.trim(name), r"\s+")).alias("at", "word"))
    odd = words.where(F.length("word") > 1).select("word").distinct()
    odd = odd.join(dictionary.select(F.col(entry).alias("word")).distinct(), "word", "left_anti")
    fixed = nearest(odd, "word", dictionary, entry, 2 if arabic else 1)
    if arabic:
        plain = lambda c: F.translate(c, ALEF_VARIANTS, "ا" * len(ALEF_VARIANTS))
        same = dictionary.groupBy(plain(F.col(entry)).alias("plain")).agg(F.min(entry).alias("variant"))
        fixed = fixed.withColumn("plain", plain(F.col("word"))).join(same, "plain", "left").withColumn("nearest", F.coalesce("variant", "nearest"))
    joined = words.join(fixed.select("word", "nearest"), "word", "left").withColumn("word", F.coalesce("nearest", "word"))
    put = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ")
    out = joined.groupBy(key).agg(F.first(name).alias("_given"), put.alias("_put"))
    result = F.when(F.trim("_given") == "", F.col("_given")).when(F.col("_given").isNotNull(), F.col("_put"))
    return out.select(key, result.alias("corrected"), F.coalesce(result != F.col("_given"), F.lit(False)).alias("changed"))


def without_label(value, labels: list[str]) -> Column:
    """The value without the first of the labels that it starts with."""
    v = value if isinstance(value, Column) else F.col(value)
    strip = lambda n: F.trim(F.regexp_replace(F.substr(v, F.lit(n + 1)), r"^[\s:：]+", ""))
    return reduce(lambda c, label: c.when(v.startswith(label), strip(len(label))), labels, F.when(F.lit(False), v)).otherwise(v)


def reasons(signals, result, approve: float = 0.80, review: float = 0.60) -> Column:
    """The decision in five written steps: signals, weights, contributions,
    thresholds, codes with their severity.  Takes ``risk.signals()`` as a map and
    the struct of ``risk.evaluate()``."""
    listed = lambda items, line: F.array_join(F.transform(items, line), "\n")
    facts = listed(F.array_sort(F.map_entries(signals)), lambda e: F.format_string("  %s = %.4f", e["key"], e["value"]))
    weights = listed(result["factors"], lambda f: F.format_string("  %s: %.2f", f["factor"], f["weight"]))
    parts = listed(result["factors"], lambda f: F.format_string("  %s: %.4f x %.2f = %.4f", f["factor"], f["value"], f["weight"], f["contribution"]))
    score = result["score"]
    band = F.when(score >= approve, "approve").when(score >= review, "review").otherwise("reject")
    codes = listed(result["codes"], lambda c: F.format_string("  [%s] %s", F.upper(severity(c)), c))
    steps = [
        F.lit("1. Signals"), facts, F.lit("2. Weights"), weights, F.lit("3. Contributions"), parts,
        F.format_string(f"4. Thresholds: approve {approve:.2f}, review {review:.2f}; score %.4f lies in %s", score, band),
        F.format_string("5. Decision: %s", F.upper(result["decision"])), codes,
    ]
    return F.concat_ws("\n", *steps)
