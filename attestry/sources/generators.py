"""Seeded synthetic identities, IDs, zones and rings from ``spark.range``.

A value depends on (seed, row, column) alone, so any partitioning gives the same
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.mrz import check_digit

GIVEN = ("ANNA", "OMAR", "LINA", "KARIM", "SARA", "JOHN", "MAYA", "ALI", "NORA", "ADAM")
FAMILY = ("ERIKSSON", "HASSAN", "SMITH", "FAROUK", "NASSER", "LEE", "GARCIA", "KHAN", "IVANOV", "MEYER")


def draw(seed: int, column: str, below: int, row: str = "id") -> Column:
    """A number below ``below`` for each row."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(column), F.col(row)), F.lit(below)).cast("long")


def pick(seed: int, column: str, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (draw(seed, column, len(values)) + 1).cast("int"))


def identities(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    born = F.date_add(F.lit("1950-01-01").cast("date"), draw(seed, "birth", 20_000).cast("int"))
    issued = F.date_add(F.lit("2015-01-01").cast("date"), draw(seed, "issue", 3_000).cast("int"))
    return spark.range(n).select(
        "id",
        F.concat_ws(" ", pick(seed, "given", GIVEN), pick(seed, "family", FAMILY)).alias("full_name_en"),
        born.alias("birth_date"),
        F.when(draw(seed, "sex", 2) == 0, "Male").otherwise("Female").alias("gender"),
        issued.alias("issue_date"),
        F.add_months(issued, 120).alias("expiry_date"),
        F.concat(F.lit("D"), F.lpad(draw(seed, "doc", 10**8).cast("string"), 8, "0")).alias("document_no"),
    )


def zones(people: DataFrame, issuer: str = "UTO", corrupt_every: int = 0) -> DataFrame:
    """Adds ``mrz_text``: a valid three-line zone, every n-th with a wrong digit."""
    yymmdd = lambda c: F.date_format(c, "yyMMdd")
    number = F.rpad("document_no", 9, "<")
    wrong = (F.pmod("id", F.lit(corrupt_every)) == 0).cast("int") if corrupt_every else F.lit(0)
    line1 = F.rpad(F.concat(F.lit(f"I<{issuer}"), number, ((check_digit(number) + wrong) % 10).cast("string")), 30, "<")
    birth, expiry = yymmdd("birth_date"), yymmdd("expiry_date")
    sex = F.substring("gender", 1, 1)
    half = F.concat(birth, check_digit(birth).cast("string"), sex, expiry, check_digit(expiry).cast("string"), F.lit(issuer))
    covered = F.concat(F.substring(line1, 6, 25), F.substring(half, 1, 7), F.substring(half, 9, 7), F.substring(half, 16, 3), F.lit("<" * 11))
    line2 = F.concat(F.rpad(half, 29, "<"), check_digit(covered).cast("string"))
    names = F.split("full_name_en", " ")
    line3 = F.rpad(F.concat(names[1], F.lit("<<"), names[0]), 30, "<")
    return people.withColumn("mrz_text", F.concat_ws("\n", line1, line2, line3))


def luhn_ids(spark: SparkSession, n: int, digits: int = 9, seed: int = 1, corrupt_every: int = 0) -> DataFrame:
    """IDs whose last digit makes the digit sum (odd places doubled) a multiple of 10."""
    body = F.lpad(draw(seed, "body", 10 ** (digits - 1)).cast("string"), digits - 1, "0")
    value = lambda c, i: F.when(i % 2 == 1, F.when(c > 4, 2 * c - 9).otherwise(2 * c)).otherwise(c)
    total = F.aggregate(F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c, i: value(c.cast("int"), i)), F.lit(0), lambda s, v: s + v)
    last = (10 - total % 10) % 10 if (digits - 1) % 2 == 0 else F.element_at(F.array(*[F.lit(x) for x in (0, 5, 1, 6, 2, 7, 3, 8, 4, 9)]), ((10 - total % 10) % 10 + 1).cast("int"))
    wrong = (F.pmod("id", F.lit(corrupt_every)) == 0).cast("int") if corrupt_every else F.lit(0)
    return spark.range(n).select("id", F.concat(body, ((last + wrong) % 10).cast("string")).alias("national_id"), (wrong == 0).alias("expect_valid"))


def fraud_rings(spark: SparkSession, n: int, seed: int = 1, most: int = 10) -> DataFrame:
    """Edges of rings of 3 to ``most`` members that share one device."""
    size = 3 + draw(seed, "size", most - 2)
    member = F.explode(F.sequence(F.lit(1).cast("long"), size))
    return spark.range(n).select("id", member.alias("m")).select(F.concat(F.lit("p"), "id", F.lit("_"), "m").alias("src"), F.concat(F.lit("device"), "id").alias("dst"), F.lit("shared_device").alias("type"))
