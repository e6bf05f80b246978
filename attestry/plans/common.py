"""Views of the driver's tables as identity-risk data, in Spark and DuckDB.

``signals``: events with a hub key ``k`` (from the props), a value squashed to
0..1 and a place derived from ``k``.  The SQL text has the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.sources.tables import read

SIGNALS_SQL = """signals as (
  select event_id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) k,
         least(1.0::double, value / 100.0::double) drift,
         (cast(json_extract_string(props, '$.k') as bigint) * 37 % 140 - 70)::double lat, (cast(json_extract_string(props, '$.k') as bigint) * 91 % 340 - 170)::double lon
  from events)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return read(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", k.alias("k"), F.least(F.lit(1.0), F.col("value") / 100).alias("drift"), (k * 37 % 140 - 70).cast("double").alias("lat"), (k * 91 % 340 - 170).cast("double").alias("lon")
    )
