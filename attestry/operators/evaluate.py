"""Evaluation runs, latency and confusion figures, histograms and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.numbers import half_up, ratio

LATENCY_BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def nearest_rank(value, p: float) -> Column:
    """Percentile by nearest rank, an aggregate."""
    return F.expr(f"percentile_disc({p}) within group (order by {value})")


def latency(rows: DataFrame, value: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(half_up(F.avg(value)).alias("mean"), nearest_rank(value, 0.5).alias("p50"), nearest_rank(value, 0.95).alias("p95"), nearest_rank(value, 0.99).alias("p99"), F.min(value).alias("min"), F.max(value).alias("max"))


def histogram(rows: DataFrame, value: str, *by: str, bounds: tuple[float, ...] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative counts up to each bound and to infinity, one row a bucket."""
    counts = [F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in (*bounds, float("inf"))]
    wide = rows.groupBy(*by).agg(F.array(*counts).alias("b"), F.sum(value).alias("sum"), F.count(value).alias("count"))
    return wide.select(*by, F.explode("b").alias("b"), "sum", "count").select(*by, F.col("b.le").alias("le"), F.col("b.n").alias("n"), "sum", "count")


def confusion(rows: DataFrame, truth: Column, said: Column, *by: str) -> DataFrame:
    """Counts and rates, 4 places; a rate without a case is 0."""
    n = rows.groupBy(*by).agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & ~said).alias("tn"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"))
    precision, recall = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    apcer, bpcer = ratio("fp", F.col("fp") + F.col("tn")), ratio("fn", F.col("fn") + F.col("tp"))
    return n.select(
        *by, "tp", "tn", "fp", "fn",
        half_up(ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), 4).alias("accuracy"),
        half_up(precision, 4).alias("precision"), half_up(recall, 4).alias("recall"), half_up(ratio(2 * precision * recall, precision + recall), 4).alias("f1"),
        half_up(apcer, 4).alias("apcer"), half_up(bpcer, 4).alias("bpcer"), half_up((apcer + bpcer) / 2, 4).alias("acer"),
    )


def field_rows(results: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Wide (x_expected, x_actual, x_correct) triples to a row for each field."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_expected").alias("expected"), F.col(f"{f}_actual").alias("actual"), F.col(f"{f}_correct").alias("correct")) for f in fields])
    return results.select(*key, F.inline(each))


def field_accuracy(long: DataFrame, labelled_only: bool = False) -> DataFrame:
    """By field: correct, total, accuracy.  Rows without ground truth count as
    they were judged, or not at all with ``labelled_only``."""
    rows = long.where(F.col("expected").isNotNull()) if labelled_only else long
    return rows.groupBy("field").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total")).withColumn("accuracy", half_up(ratio("correct", "total"), 4))


def counters(rows: DataFrame, name: str, labels: Column, value: str) -> DataFrame:
    """Sums by name and label set; the order of labels doesn't matter."""
    key = F.map_from_entries(F.array_sort(F.map_entries(labels)))
    return rows.groupBy(name, F.to_json(key).alias("labels")).agg(F.sum(value).alias("value"))


def gauges(rows: DataFrame, name: str, labels: Column, value: str, ts: str, order: str) -> DataFrame:
    key = F.map_from_entries(F.array_sort(F.map_entries(labels)))
    return rows.groupBy(name, F.to_json(key).alias("labels")).agg(F.max_by(value, F.struct(ts, order)).alias("value"))


def health(rows: DataFrame, passed: str) -> DataFrame:
    """Share of passed checks in whole percent, with a verdict."""
    score = half_up(100 * F.avg(F.col(passed).cast("int")), 0)
    return rows.agg(score.alias("score")).withColumn("verdict", F.when(F.col("score") == 100, "PERFECT HARMONY").when(F.col("score") >= 80, "GOOD").when(F.col("score") >= 60, "DEGRADED").otherwise("CRITICAL"))


def verification_summary(rows: DataFrame, now: Column, days: int) -> DataFrame:
    """``metric``, ``key``, ``value`` of records (status, doc_type, created_at,
    doc, face, live, image), from one aggregation.

    Totals, counts and whole percents by status, counts of the last ``days``,
    averages with nulls as 0, counts by type, and the last 24 hours by hour of day,
    with a row for each hour.
    """
    recent = F.col("created_at") > now - F.make_dt_interval(F.lit(days))
    day = (F.col("created_at") > now - F.make_dt_interval(F.lit(1))).alias("day")
    by = rows.select("*", recent.alias("recent"), day, F.hour("created_at").alias("hour"))
    zero = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c)
    # Few groups: statuses x types x hours.
    small = by.groupBy("status", "doc_type", F.when(F.col("day"), F.col("hour")).alias("hour")).agg(F.count("*").alias("n"), F.count_if("recent").alias("r"), *map(zero, ("doc", "face", "live", "image")))
    n = F.sum("n").cast("double")
    of = lambda s, c="n": F.coalesce(F.sum(F.when(F.col("status") == s, F.col(c))), F.lit(0)).cast("double")
    row = lambda metric, key, value: F.struct(F.lit(metric).alias("metric"), F.lit(key).alias("key"), F.round(value, 6).alias("value"))
    cells = [row("total", "", F.coalesce(n, F.lit(0.0))), row("recent", "", F.coalesce(F.sum("r"), F.lit(0)).cast("double"))]
    cells += [row("count", s, of(s)) for s in ("verified", "failed", "pending")] + [row("rate", s, half_up(ratio(100 * of(s), n))) for s in ("verified", "failed")]
    cells += [row("recent_status", s, of(s, "r")) for s in ("verified", "failed", "pending")] + [row("average", c, ratio(F.sum(c), n)) for c in ("doc", "face", "live", "image")]
    cells += [row("hour", f"{h:02d}", F.coalesce(F.sum(F.when(F.col("hour") == h, F.col("n"))), F.lit(0)).cast("double")) for h in range(24)]
    whole = small.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return whole.unionByName(small.groupBy("doc_type").agg(n.alias("value")).select(F.lit("type").alias("metric"), F.col("doc_type").alias("key"), "value"))
