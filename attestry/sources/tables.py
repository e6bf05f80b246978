"""Table access: scans with filters, lookups, counts, writes, projections."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_SKIP = object()
#: Marks a filter value as not given (None means null).
MISSING = _SKIP


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def where_equal(filters: dict[str, Any]) -> Column:
    """All equalities at once; missing values are skipped, None asks for null."""
    parts = [F.col(k).isNull() if v is None else F.col(k) == F.lit(v) for k, v in filters.items() if v is not MISSING]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def find_many(df: DataFrame, where: dict[str, Any] | None = None, order_by: list[tuple[str, bool]] | None = None, take: int | None = None, select: list[str] | None = None) -> DataFrame:
    """Filter, order (column, ascending), take, project; all reach the scan."""
    out = df.where(where_equal(where or {}))
    if order_by:
        out = out.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in order_by])
    if take is not None:
        out = out.limit(take)
    return out.select(*select) if select else out


def find_first(df: DataFrame, where: dict[str, Any]) -> DataFrame:
    return df.where(where_equal(where)).limit(1)


def count(df: DataFrame, where: dict[str, Any] | None = None) -> DataFrame:
    return df.where(where_equal(where or {})).agg(F.count("*").alias("n"))


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str, most: int = 500) -> DataFrame:
    """Parents with an array of their first ``most`` children in order; the others are left out before anything is gathered."""
    rest = [c for c in children.columns if c not in (key, order)]
    first = children.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order, *rest))).where(F.col("_n") <= most)
    rows = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("children"))
    return parents.join(rows, key, "left")


def without(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def insert(df: DataFrame, path: str, key: str | None = None) -> int:
    """Append rows, once for each key within the batch and against the table."""
    spark = df.sparkSession
    rows = df.dropDuplicates([key]) if key else df
    if key:
        try:
            have = spark.read.parquet(path).select(key)
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            rows = rows.join(have, key, "left_anti")
    seen = Observation()
    rows.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(path)  # counted as they are written
    return seen.get["n"]


def rewritten(df: DataFrame, where: dict[str, Any], values: dict[str, Any]) -> DataFrame:
    """The table after an update."""
    hit = F.coalesce(where_equal(where), F.lit(False))
    return df.select(*[F.when(hit, F.lit(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def deleted(df: DataFrame, where: dict[str, Any]) -> DataFrame:
    """The table after a deletion."""
    return df.where(~F.coalesce(where_equal(where), F.lit(False)))


def cascade_deleted(parents: DataFrame, children: DataFrame, key: str, where: dict[str, Any]) -> tuple[DataFrame, DataFrame]:
    gone = parents.where(where_equal(where)).select(key)
    return deleted(parents, where), children.join(gone, key, "left_anti")


def write_csv(df: DataFrame, path: str, newest: int | None = None, by: str = "created_at", tie: str | None = None) -> None:
    """RFC 4180: quotes only where needed, nulls empty.  Of rows of one time, those with the least ``tie`` (all columns, if none is named) come first."""
    out = df.orderBy(F.desc(by), *([tie] if tie else df.columns)).limit(newest) if newest else df
    out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A remote SQL table; filters and columns are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_jdbc(df: DataFrame, url: str, table: str, defaults: dict[str, Any] | None = None, **options: str) -> None:
    """Mirror rows to a remote table; nulls of the columns named get defaults."""
    df.na.fill(defaults or {}).write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def ingest(spark: SparkSession, path: str, max_bytes: int = 100 << 20, kinds: tuple[str, ...] = ("pdf", "json", "csv", "xml", "png", "jpg")) -> DataFrame:
    """Files with their SHA-256 and the first gate they fail, if any."""
    files = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    failed = F.when(~ext.isin(*kinds), "kind").when(F.col("length") > max_bytes, "size").when(F.col("length") == 0, "empty")
    return files.select("path", "modificationTime", "length", ext.alias("kind"), F.sha2("content", 256).alias("sha256"), failed.alias("failed"))
