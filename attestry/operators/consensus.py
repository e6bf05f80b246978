"""Agreement of several readings of one case, and nearest dictionary entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.numbers import bound, half_up
from attestry.functions.text import similarity


def vote(rows: DataFrame, case: str, decision: str) -> DataFrame:
    """Most frequent decision of a case and its share; ties go to the first in
    alphabetical order."""
    counts = rows.groupBy(case, decision).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(case))
    best = F.row_number().over(Window.partitionBy(case).orderBy(F.desc("n"), decision))
    return counts.select(case, F.col(decision).alias("winner"), (F.col("n") / total).alias("share"), best.alias("_r")).where("_r = 1").drop("_r")


def majority(rows: DataFrame, case: str, flag: str) -> DataFrame:
    """True if more than half are true."""
    return rows.groupBy(case).agg((F.count_if(flag) * 2 > F.count(flag)).alias("majority"))


def numeric(rows: DataFrame, case: str, value: str) -> DataFrame:
    """Mean, and 1 - deviation / max(1, range)."""
    agree = 1 - F.coalesce(F.stddev_pop(value), F.lit(0.0)) / F.greatest(F.lit(1.0), F.max(value) - F.min(value))
    return rows.groupBy(case).agg(half_up(F.avg(value), 3).alias("mean"), agree.alias("agreement"))


def most_alike(rows: DataFrame, case: str, source: str, text: str) -> DataFrame:
    """The reading with the largest mean similarity to the others of its case.

    Pairs stay within a case, which has a reading for each source.
    """
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col(f"a.{case}") == F.col(f"b.{case}")) & (F.col(f"a.{source}") != F.col(f"b.{source}")), "left")
    scored = pairs.groupBy(F.col(f"a.{case}").alias(case), F.col(f"a.{source}").alias(source), F.col(f"a.{text}").alias(text)).agg(F.coalesce(F.avg(F.when(F.col(f"b.{source}").isNotNull(), similarity(f"a.{text}", f"b.{text}"))), F.lit(1.0)).alias("alike"))
    best = F.row_number().over(Window.partitionBy(case).orderBy(F.desc("alike"), source))
    return scored.withColumn("_r", best).where("_r = 1").drop("_r")


def clusters(rows: DataFrame, case: str, order: str, text: str, least: float = 0.85) -> DataFrame:
    """Greedy single-pass clusters of a case's readings: each joins the first
    cluster whose representative (its shortest member) is alike enough.  Returns
    the largest cluster's representative and share.  Readings of one place in order
    come by their text, those without a place last.

    The pass depends on its own earlier steps, so it is a fold over a case's array.
    """
    reading = F.when(F.col(text).isNotNull(), F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("at"), F.col(text).alias("said")))
    said = rows.groupBy(case).agg(F.array_sort(F.collect_list(reading)).alias("_said"))

    def alike(group: Column, t: Column) -> Column:
        n = F.greatest(F.length(group["rep"]), F.length(t))
        return (n == 0) | (1 - F.levenshtein(F.lower(group["rep"]), F.lower(t)) / n >= least)

    def joined(groups: Column, t: Column, at: Column) -> Column:
        member = lambda g: F.struct(F.when(F.length(t) < F.length(g["rep"]), t).otherwise(g["rep"]).alias("rep"), (g["n"] + 1).alias("n"))
        return F.when(at == 0, F.concat(groups, F.array(F.struct(t.alias("rep"), F.lit(1).alias("n"))))).otherwise(F.transform(groups, lambda g, i: F.when(i + 1 == at, member(g)).otherwise(g)))

    def step(groups: Column, r: Column) -> Column:
        return bound(r["said"], lambda t: bound(F.array_position(F.transform(groups, lambda g: alike(g, t)), True), lambda at: joined(groups, t, at)))

    groups = F.aggregate("_said", F.array().cast("array<struct<rep: string, n: int>>"), step)
    top = F.array_max(F.transform(groups, lambda g, i: F.struct(g["n"].alias("n"), (-i).alias("i"), g["rep"].alias("rep"))))
    out = said.select(case, F.size("_said").alias("_size"), top.alias("_top"))
    return out.select(case, F.col("_top.rep").alias("winner"), F.coalesce(F.col("_top.n") / F.col("_size"), F.lit(0.0)).alias("share"))


def nearest(words: DataFrame, word: str, dictionary: DataFrame, entry: str, most: int = 2, how_broadcast: bool = False) -> DataFrame:
    """For each word the dictionary entry within ``most`` edits, fewest first, then
    alphabetical; words without one keep a null.

    Distinct words meet entries of nearly their length only: each word is sent
    to ``2 * most + 1`` lengths, an equi-join.
    """
    distinct = words.select(F.col(word).alias("w")).distinct().where("w is not null")
    bands = distinct.select("w", F.explode(F.sequence(F.length("w") - most, F.length("w") + most)).alias("n"))
    entries = dictionary.select(F.col(entry).alias("e")).distinct().withColumn("n", F.length("e"))
    near = bands.join(F.broadcast(entries) if how_broadcast else entries, "n").withColumn("d", F.levenshtein("w", "e", most)).where("d >= 0")
    best = near.groupBy("w").agg(F.min(F.struct("d", "e")).alias("b"))
    return words.join(best, words[word] == F.col("w"), "left").select(*words.columns, F.col("b.e").alias("nearest"), F.col("b.d").alias("edits"))


def agreement_level(share: Column) -> Column:
    return F.when(share >= 0.99, "unanimous").when(share > 0.5, "majority").otherwise("split")
