"""Document reading: template fields, label-driven extraction, repairs,
explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.numbers import centre_distance, clamp, half_up, iou
from attestry.functions.text import canonical, clean_numeric_id


def match_fields(read: DataFrame, template: DataFrame, doc: str = "doc_id", least_iou: float = 0.30, most_apart: float = 0.10) -> DataFrame:
    """Each template field's reading: by name or alias first, then by place.

    ``read`` has doc, name, value, box; ``template`` has field, aliases, box, and
    is a small dimension.
    """
    t = template.select("field", F.transform("aliases", lambda a: canonical(a)).alias("aliases"), F.col("box").alias("t_box"), F.col("seq").alias("t_seq"))
    pairs = read.crossJoin(F.broadcast(t))
    named = F.array_contains("aliases", canonical("name")) | (canonical("name") == canonical("field"))
    near = (iou("box", "t_box") >= least_iou) | (centre_distance("box", "t_box") < most_apart)
    ranked = pairs.where(named | near).withColumn("by", F.when(named, "name").otherwise("place"))
    w = Window.partitionBy(doc, "field").orderBy(F.when(F.col("by") == "name", 0).otherwise(1), F.desc(iou("box", "t_box")), "seq")
    return ranked.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(doc, "field", "value", "by")


def labelled(text, labels: list[str], stops: list[str]) -> Column:
    """What follows the first label up to the next label or line end."""
    s = F.col(text) if isinstance(text, str) else text
    end = "|".join(stops)
    found = [F.nullif(F.trim(F.regexp_extract(s, rf"(?is)\b{label}\s*[:\-]?\s*(.*?)\s*(?:\n|$|\b(?:{end})\b)", 1)), F.lit("")) for label in labels]
    return F.coalesce(*found)


def first_pattern(text, patterns: list[tuple[str, float]]) -> Column:
    """The first pattern that matches, with its confidence."""
    s = F.col(text) if isinstance(text, str) else text
    hits = [F.when(s.rlike(p), F.struct(F.regexp_extract(s, p, 1).alias("value"), F.lit(c).alias("confidence"))) for p, c in patterns]
    return F.coalesce(*hits)


def repaired_id(df: DataFrame, key: str, raw: str, size: int, check) -> DataFrame:
    """Repair of an ID read with one digit too many or too few.

    Candidates drop each digit, or put each digit in at each place; those whose
    ``check`` (a Column of a digit string) holds come first, then by order.
    """
    s = clean_numeric_id(raw)
    drop = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, 1, 0 + size + 1).substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s))))
    add = F.flatten(F.transform(F.sequence(F.lit(0), F.length(s)), lambda i: F.transform(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: F.concat(s.substr(F.lit(1), i), d, s.substr(i + 1, F.length(s))))))
    options = F.when(F.length(s) == size, F.array(s)).when(F.length(s) == size + 1, drop).when(F.length(s) == size - 1, add).otherwise(F.array().cast("array<string>"))
    rows = df.select(key, F.posexplode(options).alias("pos", "candidate")).where(F.length("candidate") == size)
    best = rows.groupBy(key).agg(F.min(F.struct((~F.coalesce(check(F.col("candidate")), F.lit(False))).alias("bad"), "pos", "candidate")).alias("b"))
    return df.join(best, key, "left").select(*df.columns, F.col("b.candidate").alias("repaired"), (~F.col("b.bad")).alias("repaired_ok"))


#: What each finding adds to an explained score (times 20 points).
FACTORS = {
    "AI Consensus Agreement": 0.3, "AI Consensus Agreement (2)": 0.15, "AI Consensus Disagreement": -0.2, "Provider Diversity": 0.05, "OCR Correction Applied": 0.05,
    "ID Checksum Valid": 0.1, "ID Format Invalid": -0.15, "ID Checksum Mismatch": -0.1, "Cross-Field Critical Flag": -0.2, "Cross-Field Consistency": 0.1, "Cross-Field Inconsistency": -0.1,
    "Fraud Probability": -0.15, "Image Blur": -0.1, "Glare Detected": -0.05, "Lighting": -0.05, "Good Image Quality": 0.05, "Liveness Challenge Met": 0.1, "Liveness Challenge Failed": -0.15,
    "Anti-Spoofing Passed": 0.05, "Document Tampering Detected": -0.3, "No Tampering Detected": 0.05,
}


def explained(doc_confidence: Column, face: Column, live: Column, found: list[tuple[str, Column]]) -> Column:
    """Base of document (0..1), face and liveness (0..100) by 30, 40 and 30
    percent, findings that hold (names of FACTORS, conditions), and the score in
    whole points of 0 to 100."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    some = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(name.split(" (")[0]).alias("factor"), F.lit(FACTORS[name]).alias("contribution"))) for name, when in found]))
    total = F.aggregate(some, F.lit(0.0), lambda s, x: s + x["contribution"])
    base = zero(doc_confidence) * 100 * 0.3 + zero(face) * 0.4 + zero(live) * 0.3
    return F.struct(some.alias("factors"), half_up(base).alias("base"), half_up(total * 20).alias("adjustment"), clamp(half_up(base + total * 20), 0.0, 100.0).alias("score"))


def consensus_findings(agreeing: Column, providers: Column) -> list[tuple[str, Column]]:
    return [("AI Consensus Agreement", agreeing >= 3), ("AI Consensus Agreement (2)", agreeing == 2), ("AI Consensus Disagreement", agreeing < 2), ("Provider Diversity", providers > 0)]


def id_findings(valid: Column, checksum: Column) -> list[tuple[str, Column]]:
    return [("ID Checksum Valid", checksum), ("ID Format Invalid", ~checksum & ~valid), ("ID Checksum Mismatch", ~checksum & valid)]


def cross_field_findings(critical: Column, consistency: Column, fraud: Column) -> list[tuple[str, Column]]:
    return [("Cross-Field Critical Flag", critical), ("Cross-Field Consistency", ~critical & (consistency >= 0.8)), ("Cross-Field Inconsistency", ~critical & (consistency > 0) & (consistency < 0.5)), ("Fraud Probability", fraud > 0.3)]


def other_documents(docs: DataFrame, user: str = "user_id", doc: str = "doc_id") -> DataFrame:
    """Pairs of one user's documents that disagree on birth date or sex.

    Compared through the user's own values, not pair by pair.
    """
    by = Window.partitionBy(user)
    spread = lambda c: F.size(F.collect_set(c).over(by)) > 1
    return docs.select(user, doc, spread("birth_date").alias("birth_date_differs"), spread("gender").alias("gender_differs"))
