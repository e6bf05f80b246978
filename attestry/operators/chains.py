"""Tamper-evident chains: building, verifying, Merkle roots, exports."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.streaming.folds import in_order


def link(previous: Column, payload: Column) -> Column:
    """Hash of an entry over the one before it; the first follows ''."""
    return F.sha2(F.concat(F.coalesce(previous, F.lit("")), F.lit("|"), payload), 256)


def canonical_json(*columns: str) -> Column:
    """JSON with keys in alphabetical order and nulls left out."""
    return F.to_json(F.struct(*sorted(columns)))


def build(events: DataFrame, key: str, order: list[str], payload: str, genesis: str = "") -> DataFrame:
    """Adds ``idx``, ``prev_hash`` and ``hash`` along each key's order.

    Each hash needs the last, so chains are kept by key, never one for the whole
    table; a partition is sorted by key and read in batches.
    """
    names = [key, "idx", *order, payload, "prev_hash", "hash"]

    def step(state: dict, row: dict) -> tuple[dict, tuple]:
        idx, before = state.get("idx", 0), state.get("hash", genesis)
        done = hashlib.sha256(f"{before}|{row[payload]}".encode()).hexdigest()
        return {"idx": idx + 1, "hash": done}, (row[key], idx, *[row[c] for c in order], row[payload], before, done)

    rows = events.select(key, *order, F.coalesce(F.col(payload).cast("string"), F.lit("")).alias(payload))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {"idx": "int", "prev_hash": "string", "hash": "string"}
    return in_order(rows, key, order, names, step, ", ".join(f"`{n}` {kinds[n]}" for n in names))


def checked(chain: DataFrame, key: str, payload: str, idx: str = "idx", genesis: str = "") -> DataFrame:
    """By key: entries, ``first_broken`` index (null if none) and ``intact``.

    Each entry is checked on its own against the one before, so all in parallel.
    """
    w = Window.partitionBy(key).orderBy(idx)
    before = F.coalesce(F.lag("hash").over(w), F.lit(genesis))
    bad = (F.col("prev_hash") != before) | (F.col("hash") != link(F.col("prev_hash"), F.col(payload)))
    checked = chain.select(key, idx, F.coalesce(bad, F.lit(True)).alias("bad"))
    return checked.groupBy(key).agg(F.count("*").alias("entries"), F.min(F.when(F.col("bad"), F.col(idx))).alias("first_broken")).withColumn("intact", F.col("first_broken").isNull())


def merkle_roots(leaves: DataFrame, key: str, order: str, value: str, max_rounds: int = 64) -> DataFrame:
    """``key``, ``root``: pairs are hashed level by level, a last odd node with
    itself.  log2(n) rounds, each half the size of the last."""
    w = Window.partitionBy(key).orderBy(order)
    level = leaves.select(key, (F.row_number().over(w) - 1).cast("long").alias("i"), F.sha2(F.col(value).cast("string"), 256).alias("h"))
    for _ in range(max_rounds):
        if level.where("i > 0").isEmpty():
            return level.select(key, F.col("h").alias("root"))
        pair = level.groupBy(key, F.floor(F.col("i") / 2).alias("i")).agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"), F.max("i").alias("top"))
        # A tree of one leaf is its own root and stays.
        alone = Window.partitionBy(key)
        level = pair.withColumn("n", F.max("top").over(alone)).select(key, F.col("i").cast("long").alias("i"), F.when(F.col("n") == 0, F.col("a")).otherwise(F.sha2(F.concat("a", "b"), 256)).alias("h"))
        level = _cut(level)
    raise RuntimeError("too many leaves")


def _cut(df: DataFrame) -> DataFrame:
    from attestry.operators.graph import _cut as cut

    return cut(df)


def provenance(rows: DataFrame, key: str, steps: list[tuple[str, Column]]) -> DataFrame:
    """A row for each step, whose input hash is the last step's output hash."""
    previous, out = F.lit(""), []
    for name, payload in steps:
        done = F.sha2(F.concat(previous, F.lit("|"), F.lit(name), F.lit("|"), F.coalesce(payload.cast("string"), F.lit(""))), 256)
        out.append(F.struct(F.lit(name).alias("step"), previous.alias("input_hash"), done.alias("output_hash")))
        previous = done
    return rows.select(key, F.posexplode(F.array(*out)).alias("idx", "s")).select(key, "idx", "s.step", "s.input_hash", "s.output_hash")


def content_id(payload: Column, prefix: str = "att_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(payload.cast("string"), 256), 1, 32))


def commitment(value: Column, salt: Column) -> Column:
    return F.sha2(F.concat(value.cast("string"), F.lit(":"), salt.cast("string")), 256)


def signed(secret: str):
    """A pandas UDF: HMAC-SHA256 of a string column (no built-in has it)."""

    @F.pandas_udf("string")
    def sign(text: pd.Series) -> pd.Series:
        key = secret.encode()
        return text.map(lambda t: None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest())

    return sign


def subject_export(parts: dict[str, DataFrame], key: str, order: str) -> DataFrame:
    """A row for each subject: JSON of all its rows by part, and its SHA-256."""
    folded = None
    for name in sorted(parts):
        rows = parts[name]
        own = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.to_json(F.struct(*sorted(c for c in rows.columns if c != key))).alias("j")))), lambda x: x["j"]).alias(name))
        folded = own if folded is None else folded.join(own, key, "full")
    body = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":['), F.coalesce(F.array_join(n, ","), F.lit("")), F.lit("]")) for n in sorted(parts)]), F.lit("}"))
    return folded.select(key, body.alias("document")).withColumn("sha256", F.sha2("document", 256))
