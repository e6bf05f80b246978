"""Fairness metrics over decisions in long form.

A metric is a row: ``metric``, ``value``, ``status`` (pass, review, fail or
unknown).  Groups are aggregated once; every metric then works on a row a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.numbers import ratio

ORDER = ("pass", "unknown", "review", "fail")


def group_stats(outcomes: DataFrame, group: str = "value", decision: str = "decision", legitimate: str | None = None) -> DataFrame:
    """Counts by group; with ground truth also the two rates of errors."""
    yes = F.col(decision) == "approve"
    out = [F.count_if(yes).alias("approved"), F.count_if(F.col(decision) == "reject").alias("rejected"), F.count_if(F.col(decision) == "review").alias("reviewed"), F.count("*").alias("total")]
    if legitimate:
        good = F.col(legitimate)
        out += [F.count_if(yes & good).alias("tp"), F.count_if(good).alias("positives"), F.count_if(yes & ~good).alias("fp"), F.count_if(~good).alias("negatives")]
    stats = outcomes.groupBy(group).agg(*out).withColumn("p_approve", ratio("approved", "total"))
    if legitimate:
        stats = stats.withColumn("tpr", ratio("tp", "positives")).withColumn("fpr", ratio("fp", "negatives"))
    return stats


def parity(stats: DataFrame, rate: str = "p_approve", group: str = "value", counted: str = "total") -> DataFrame:
    """Smallest rate over largest, with both groups; 1 without a positive rate."""
    has = stats.where(F.col(counted) > 0)
    agg = has.agg(F.min(rate).alias("lo"), F.max(rate).alias("hi"), F.min_by(group, F.struct(F.col(rate), F.col(group))).alias("lowest"), F.max_by(group, F.struct(F.col(rate), F.col(group))).alias("highest"))
    return agg.select(F.when(F.coalesce("hi", F.lit(0.0)) == 0, 1.0).otherwise(F.col("lo") / F.col("hi")).alias("ratio"), "lowest", "highest")


def _at_least(value: Column, good: float, fair: float) -> Column:
    return F.when(value >= good, "pass").when(value >= fair, "review").otherwise("fail")


def _at_most(value: Column, good: float, fair: float) -> Column:
    return F.when(value <= good, "pass").when(value <= fair, "review").otherwise("fail")


def demographic_parity(stats: DataFrame, group: str = "value", name: str = "demographic_parity") -> DataFrame:
    return parity(stats, group=group).select(F.lit(name).alias("metric"), F.col("ratio").alias("value"), _at_least(F.col("ratio"), 0.8, 0.7).alias("status"))


def disparate_impact(stats: DataFrame, group: str = "value") -> DataFrame:
    r = F.col("ratio")
    status = F.when(r.between(0.8, 1.25), "pass").when(r.between(0.7, 1.43), "review").otherwise("fail")
    return parity(stats, group=group).select(F.lit("disparate_impact").alias("metric"), r.alias("value"), status.alias("status"))


def equal_opportunity(stats: DataFrame, group: str = "value") -> DataFrame:
    out = parity(stats, "tpr", group, "positives")
    return out.select(F.lit("equal_opportunity").alias("metric"), F.col("ratio").alias("value"), _at_least(F.col("ratio"), 0.8, 0.7).alias("status"))


def equalized_odds(stats: DataFrame) -> DataFrame:
    """Largest gap of either rate; unknown without a group."""
    spread = lambda c, n: F.coalesce(F.max(F.when(F.col(n) > 0, F.col(c))) - F.min(F.when(F.col(n) > 0, F.col(c))), F.lit(0.0))
    out = stats.agg(F.count("*").alias("n"), F.greatest(spread("tpr", "positives"), spread("fpr", "negatives")).alias("gap"))
    return out.select(F.lit("equalized_odds").alias("metric"), F.col("gap").alias("value"), F.when(F.col("n") == 0, "unknown").otherwise(_at_most(F.col("gap"), 0.1, 0.2)).alias("status"))


def accuracy_spread(rows: DataFrame, group: str, accuracy: str, name: str = "skin_tone_bias") -> DataFrame:
    means = rows.groupBy(group).agg(F.avg(accuracy).alias("m")).agg((F.max("m") - F.min("m")).alias("spread"))
    return means.select(F.lit(name).alias("metric"), F.coalesce("spread", F.lit(0.0)).alias("value"), _at_most(F.coalesce("spread", F.lit(0.0)), 0.05, 0.1).alias("status"))


def report(metrics: DataFrame) -> DataFrame:
    """One row: the worst status and how many metrics have each."""
    rank = F.element_at(F.map_from_arrays(F.array(*map(F.lit, ORDER)), F.array(*map(F.lit, range(len(ORDER))))), F.col("status"))
    return metrics.agg(F.max_by("status", rank).alias("overall"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ORDER])


def battery(outcomes: DataFrame, group: str = "value", legitimate: str = "legitimate") -> DataFrame:
    """All metrics of one grouping, from one aggregation of the outcomes."""
    stats = group_stats(outcomes, group, legitimate=legitimate)
    return demographic_parity(stats, group).unionByName(equal_opportunity(stats, group)).unionByName(disparate_impact(stats, group)).unionByName(equalized_odds(stats))
