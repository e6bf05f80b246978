"""Prometheus text exposition, both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exposition(samples: DataFrame) -> DataFrame:
    """``name``, ``text``: HELP and TYPE once, then the samples in order.

    ``samples`` has name, kind, help, labels (string as in braces, or ''), value.
    """
    line = F.concat("name", F.when(F.col("labels") != "", F.concat(F.lit("{"), "labels", F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string"))
    rows = samples.groupBy("name").agg(F.first("kind").alias("kind"), F.first("help").alias("help"), F.array_sort(F.collect_list(line)).alias("lines"))
    return rows.select("name", F.concat_ws("\n", F.concat(F.lit("# HELP "), "name", F.lit(" "), "help"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind"), F.array_join("lines", "\n")).alias("text"))


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """``name``, ``labels``, ``value``, ``kind`` of each sample line; of repeated
    samples the first in the file is kept if ``lines`` has ``pos``."""
    s = F.trim(F.col(value))
    pattern = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{([^}]*)\})?\s+([0-9eE+.\-]+|NaN|[+-]?Inf)"
    rows = lines.where((s != "") & ~s.startswith("#") & s.rlike(pattern))
    name = F.regexp_extract(s, pattern, 1)
    out = rows.select("*", name.alias("name"), F.regexp_extract(s, pattern, 2).alias("labels"), F.regexp_extract(s, pattern, 3).try_cast("double").alias("number"))
    order = F.col("pos") if "pos" in lines.columns else F.lit(0)
    kind = F.when(F.col("name").endswith("_total") | F.col("name").endswith("count"), "counter").otherwise("gauge")
    return out.groupBy("name", "labels").agg(F.min_by("number", order).alias("value")).withColumn("kind", kind)
