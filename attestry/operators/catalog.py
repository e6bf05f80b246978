"""Reference catalogues: coverage, gaps, registries, tiers, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage_matrix(countries: DataFrame, kinds: DataFrame, specs: DataFrame, templates: DataFrame, country: str = "country", kind: str = "kind") -> DataFrame:
    """Every country with every kind: has_spec, has_template, state.

    The product is of two dimension tables, each a row a country or a kind.
    """
    grid = countries.select(country).distinct().crossJoin(F.broadcast(kinds.select(kind).distinct()))
    spec = specs.select(country, kind).distinct().withColumn("has_spec", F.lit(True))
    temp = templates.select(country, kind).distinct().withColumn("has_template", F.lit(True))
    out = grid.join(spec, [country, kind], "left").join(temp, [country, kind], "left").na.fill(False, ["has_spec", "has_template"])
    return out.withColumn("state", F.when(F.col("has_spec") & F.col("has_template"), "full").when(F.col("has_spec"), "spec_only").when(F.col("has_template"), "template_only").otherwise("none"))


def coverage_gaps(specs: DataFrame, templates: DataFrame, validators: DataFrame, country: str = "country", kind: str = "kind", id_kind: str = "national_id") -> DataFrame:
    """Specs without a template, and ID specs of countries without a validator."""
    a = specs.join(templates, [country, kind], "left_anti").select(country, kind, F.lit("template_missing").alias("gap"))
    b = specs.where(F.col(kind) == id_kind).join(validators, country, "left_anti").select(country, kind, F.lit("validator_missing").alias("gap"))
    return a.unionByName(b).distinct()


def rollup(rows: DataFrame, *dims: str) -> DataFrame:
    """Counts by each dimension alone and in all, in one pass over the rows.

    ``dim`` names the dimension ('' for the total), ``value`` its value.
    """
    long = rows.select(F.inline(F.array(F.struct(F.lit("").alias("dim"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])))
    return long.groupBy("dim", "value").agg(F.count("*").alias("n"))


def serves(countries: Column, code: Column) -> Column:
    """Membership in a list of countries; 'global' serves all."""
    return F.array_contains(countries, F.lit("global")) | F.array_contains(countries, code)


def provides(items: Column, item: Column) -> Column:
    return F.exists(items, lambda x: x == item)


def registry_summary(sources: DataFrame, by: str, countries: str) -> DataFrame:
    """By ``by``: sources and distinct countries they serve."""
    base = sources.groupBy(by).agg(F.count("*").alias("sources"))
    reach = sources.select(by, F.explode_outer(countries).alias("c")).groupBy(by).agg(F.count_distinct("c").alias("countries"))
    return base.join(reach, by, "left")


def coverage_stats(matrix: DataFrame, state: str = "state", kind: str = "kind", country: str = "country", flags: tuple[str, ...] = ()) -> DataFrame:
    """``state``, ``kind`` (null where summed up), ``entries``, distinct ``countries`` and
    the entries with each flag: by state, by kind and in all, in one aggregation."""
    counts = [F.count("*").alias("entries"), F.count_distinct(country).alias("countries"), *[F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags]]
    sums = matrix.groupingSets([[F.col(state)], [F.col(kind)], []], state, kind).agg(F.grouping_id().alias("_set"), *counts)
    by = F.element_at(F.create_map(F.lit(1), F.lit("state"), F.lit(2), F.lit("kind"), F.lit(3), F.lit("all")), F.col("_set").cast("int"))
    return sums.select(by.alias("by"), state, kind, "entries", "countries", *flags)


def registry_stats(sources: DataFrame, source: str, countries: str, dims: tuple[str, ...]) -> DataFrame:
    """``by`` (a dimension, or "all"), ``value``, distinct ``sources`` and distinct
    ``countries`` they serve: each dimension and the total, in one aggregation over
    exploded countries.  A source without countries counts as a source."""
    rows = sources.select(source, *[F.col(d).cast("string").alias(d) for d in dims], F.explode_outer(countries).alias("_country"))
    sums = rows.groupingSets([*[[F.col(d)] for d in dims], []], *dims).agg(F.grouping_id().alias("_set"), F.count_distinct(source).alias("sources"), F.count_distinct("_country").alias("countries"))
    full = (1 << len(dims)) - 1
    at = {full ^ (1 << (len(dims) - 1 - i)): d for i, d in enumerate(dims)}
    by = F.when(F.col("_set") == full, "all")
    value = F.when(F.col("_set") == full, F.lit(None).cast("string"))
    for number, d in at.items():
        by, value = by.when(F.col("_set") == number, d), value.when(F.col("_set") == number, F.col(d))
    return sums.select(by.alias("by"), value.alias("value"), "sources", "countries")


def tier_of(paths: DataFrame, path: str, rules: list[tuple[str, int]]) -> DataFrame:
    """Lowest tier whose pattern fits a path: exact, or a prefix before ``*``."""
    hits = [F.when(F.col(path).startswith(p[:-1]) if p.endswith("*") else F.col(path) == p, tier) for p, tier in rules]
    return paths.withColumn("tier", F.least(*hits, F.lit(None).cast("int")) if len(hits) > 1 else hits[0])


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def latest_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert by key: the last row wins."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def stable_id(*parts: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def valid_at(facts: DataFrame, versions: DataFrame, key: str, ts: str, start: str = "valid_from", end: str = "valid_until") -> DataFrame:
    """Facts with the version of their key that held at their time.

    An equi-join on the key; the range is a condition within it.
    """
    v = versions.withColumnRenamed(key, "_key")
    return facts.join(v, (facts[key] == v["_key"]) & (facts[ts] >= v[start]) & (v[end].isNull() | (facts[ts] < v[end])), "left").drop("_key")
