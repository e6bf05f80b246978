"""Ledgers: chained entries, Merkle trees with proofs, blocks.

A chain's entry hashes a text that holds the hash before it: ``head``, that hash,
``tail``.  Trees of any number of leaves are cut into subtrees of ``2**FAN`` leaves,
each one row with all its levels; their roots are the leaves of the next round.  So a
tree of a billion leaves takes three rounds, no window or group ever holds more than
``2**FAN`` nodes of it, and the proofs of any number of leaves take one join a round.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.numbers import bound
from attestry.operators.graph import _cut as cut
from attestry.streaming.folds import in_order

FAN = 10
EMPTY = hashlib.sha256(b"empty").hexdigest()


# Chains


def linked(rows: DataFrame, key: str, order: list[str], head: Column, tail: Column, genesis: str, size: int = 64) -> DataFrame:
    """Adds ``head``, ``tail``, ``idx``, ``prev_hash`` and ``hash`` (``size`` hex digits of
    SHA-256 of head, previous hash and tail) along each key's order.

    A null head or tail counts as empty.  A partition is sorted by key and order and
    read in batches; no chain is held as a whole.
    """
    rows = rows.select("*", F.coalesce(head, F.lit("")).alias("head"), F.coalesce(tail, F.lit("")).alias("tail"))
    columns = rows.columns
    names = [*columns, "idx", "prev_hash", "hash"]

    def step(state: dict, row: dict) -> tuple[dict, tuple]:
        idx, before = state.get("idx", 0), state.get("hash", genesis)
        done = hashlib.sha256(f"{row['head']}{before}{row['tail']}".encode()).hexdigest()[:size]
        return {"idx": idx + 1, "hash": done}, (*[row[c] for c in columns], idx, before, done)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {"idx": "long", "prev_hash": "string", "hash": "string"}
    return in_order(rows, key, order, names, step, ", ".join(f"`{n}` {kinds[n]}" for n in names))


def verified(chain: DataFrame, key: str, genesis: str, size: int = 64) -> DataFrame:
    """By key: ``entries``, ``head`` of the chain, and ``first_broken`` index (null: intact).

    Each entry is hashed anew on its own; only its link is compared with the one before.
    """
    w = Window.partitionBy(key).orderBy("idx")
    right = F.substring(F.sha2(F.concat("head", "prev_hash", "tail").cast("binary"), 256), 1, size)
    bad = (F.col("prev_hash") != F.coalesce(F.lag("hash").over(w), F.lit(genesis))) | (F.col("hash") != right) | (F.col("idx") != F.row_number().over(w) - 1)
    each = chain.select(key, "idx", "hash", F.coalesce(bad, F.lit(True)).alias("bad"))
    return each.groupBy(key).agg(F.count("*").alias("entries"), F.max_by("hash", "idx").alias("head"), F.min(F.when(F.col("bad"), F.col("idx"))).alias("first_broken"))


# Trees


def numbered(leaves: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``i``, the place of each row within its keys.

    Ranges of the order are numbered on their own and moved on by what lies before
    them, so that one large tree is not one task.
    """
    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    rows = leaves.repartitionByRange(n, *by).sortWithinPartitions(*by)
    rows = cut(rows.withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    held = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moves = held.select(*[F.col(k).alias(f"_{j}") for j, k in enumerate(keys)], F.col("_part").alias("_p"), (before - F.col("_first")).alias("_move"))
    on = F.col("_part") == F.col("_p")
    for j, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_{j}"))
    return rows.join(moves, on).select(*leaves.columns, (F.col("_at") + F.col("_move")).alias("i"))


def parent(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(left, right).cast("binary"), 256)


def _grown(leaves: Column, height: Column) -> Column:
    """Levels above and with ``leaves``: ``height`` times pairs are hashed, a last odd node with itself."""

    def above(level: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
        return F.transform(places, lambda j: parent(level[2 * j], F.coalesce(F.get(level, 2 * j + 1), level[2 * j])))

    start = F.array(leaves)
    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, lambda levels, _: F.concat(levels, F.array(bound(F.element_at(levels, -1), above))))


class Trees:
    """Merkle trees of ``hashed`` leaves: ``keys``, ``i`` and ``h`` (a hash).

    ``rounds`` are tables of subtrees: keys, ``c`` (its number), ``levels``.  The top one has one a tree.
    """

    def __init__(self, hashed: DataFrame, keys: list[str], fan: int = FAN, most: int = 16):
        self.keys, self.fan, self.rounds = keys, fan, []
        level = hashed.select(*keys, "i", "h")
        for _ in range(most):
            part = level.groupBy(*keys, F.shiftright("i", fan).alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias("leaves"))
            chunks = part.groupBy(*keys).agg(F.max("c").alias("_top"))
            on = F.lit(True)
            for k in keys:
                on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
            part = part.join(chunks.select("_top", *[F.col(k).alias(f"_{k}") for k in keys]), on).drop(*[f"_{k}" for k in keys])
            own = F.ceil(F.log2(F.size("leaves").cast("double"))).cast("int")
            part = cut(part.select(*keys, "c", _grown(F.col("leaves"), F.when(F.col("_top") == 0, own).otherwise(fan)).alias("levels"), (F.col("_top") == 0).alias("last")))
            self.rounds.append(part)
            level = part.where("not last").select(*keys, F.col("c").alias("i"), F.element_at(F.element_at("levels", -1), 1).alias("h"))
            if level.isEmpty():
                return
        raise RuntimeError("too many leaves")

    def roots(self) -> DataFrame:
        """Keys and ``root`` of each tree."""
        each = [r.where("last").select(*self.keys, F.element_at(F.element_at("levels", -1), 1).alias("root")) for r in self.rounds]
        out = each[0]
        for more in each[1:]:
            out = out.unionByName(more)
        return out

    def proofs(self, asked: DataFrame) -> DataFrame:
        """``asked`` (keys and ``i``) with ``proof``: from the leaf up, ``position`` and ``hash`` of each sibling."""
        kind = "array<struct<position:string,hash:string>>"
        rows = asked.withColumn("proof", F.array().cast(kind)).withColumn("_i", F.col("i").cast("long")).withColumn("_done", F.lit(False))
        for part in self.rounds:
            other = part.select(*[F.col(k).alias(f"_{k}") for k in self.keys], "c", "levels", "last")
            on = (F.shiftright("_i", self.fan) == F.col("c")) & ~F.col("_done")
            for k in self.keys:
                on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
            local = F.col("_i").bitwiseAND((1 << self.fan) - 1).cast("int")

            def sibling(level: Column, up: Column) -> Column:
                at = F.floor(local / F.pow(F.lit(2), up)).cast("int")
                odd = at % 2 == 1
                near = F.when(odd, level[F.greatest(at - 1, F.lit(0))]).otherwise(F.coalesce(F.get(level, at + 1), F.get(level, at)))
                return F.struct(F.when(odd, "left").otherwise("right").alias("position"), near.alias("hash"))

            path = F.transform(F.slice("levels", F.lit(1), F.size("levels") - 1), sibling)
            joined = rows.join(other, on, "left")
            rows = joined.select(*asked.columns, F.concat("proof", F.coalesce(path.cast(kind), F.array().cast(kind))).alias("proof"), F.shiftright("_i", self.fan).alias("_i"), (F.col("_done") | F.coalesce("last", F.lit(False))).alias("_done"))
        return rows.drop("_i", "_done")


def tree(leaves: DataFrame, keys: list[str], order: list[str], value: Column, fan: int = FAN) -> tuple[DataFrame, Trees]:
    """Numbered leaves with their hash ``h``, and their trees."""
    rows = cut(numbered(leaves, keys, order).withColumn("h", F.sha2(F.coalesce(value.cast("string"), F.lit("")).cast("binary"), 256)))
    return rows, Trees(rows, keys, fan)


def climbed(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's hash and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, e: F.when(e["position"] == "left", parent(e["hash"], h)).otherwise(parent(h, e["hash"])))


# Blocks


def header(index: Column, timestamp: Column, root: Column, validator: Column) -> tuple[Column, Column]:
    """What stands before and after the previous hash in a block's header."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    head = F.concat(F.lit('{"index":'), index.cast("string"), F.lit(',"timestamp":'), quoted(timestamp), F.lit(',"previousHash":"'))
    return head, F.concat(F.lit('","merkleRoot":'), quoted(root), F.lit(',"nonce":0,"validator":'), quoted(validator), F.lit("}"))


def blocks(entries: DataFrame, key: str, order: list[str], timestamp: Column, value: Column, validator: Column, size: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of ``size`` entries of each key, and the numbered entries.

    Block 0 has no entries and the root of "genesis"; a block's time is that of its
    last entry, block 0's that of the first one.  Blocks: ``key``, ``block``, ``root``,
    ``n``, and the columns of ``linked``.
    """
    rows = cut(numbered(entries.select(key, *order, timestamp.alias("_t"), value.cast("string").alias("_v")), [key], order))
    rows = rows.withColumn("block", F.floor(F.col("i") / size) + 1).withColumn("i", F.col("i") % size)
    rows = rows.withColumn("h", F.sha2(F.coalesce("_v", F.lit("")).cast("binary"), 256))
    roots = Trees(rows, [key, "block"]).roots()
    timed = rows.groupBy(key, "block").agg(F.max_by("_t", "i").alias("t"), F.min_by("_t", "i").alias("first"), F.count("*").alias("n"))
    made = timed.join(roots.withColumnsRenamed({key: "_k", "block": "_b"}), (F.col(key).eqNullSafe(F.col("_k"))) & (F.col("block") == F.col("_b"))).select(key, "block", "t", "n", "root")
    genesis = timed.where("block = 1").select(key, F.lit(0).cast("long").alias("block"), F.col("first").alias("t"), F.lit(0).cast("long").alias("n"), F.lit(hashlib.sha256(b"genesis").hexdigest()).alias("root"))
    head, tail = header(F.col("block"), F.coalesce("t", F.lit("")), F.col("root"), F.when(F.col("block") == 0, "genesis").otherwise(validator))
    return linked(made.unionByName(genesis), key, ["block"], head, tail, "0" * 64), rows.select(key, *order, "block", "i", "h")


def blocks_checked(chain: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """``key``, ``blocks``, ``head``, ``first_broken`` link and ``first_changed`` block whose entries have another root."""
    roots = Trees(entries, [key, "block"]).roots().select(F.col(key).alias("_k"), F.col("block").alias("_b"), F.col("root").alias("now"))
    held = chain.join(roots, F.col(key).eqNullSafe(F.col("_k")) & (F.col("block") == F.col("_b")), "left")
    changed = (F.col("block") > 0) & ~F.col("root").eqNullSafe(F.col("now")) | ~F.col("tail").contains(F.col("root"))
    found = held.groupBy(key).agg(F.min(F.when(changed, F.col("block"))).alias("first_changed"))
    links = verified(chain, key, "0" * 64).withColumnRenamed(key, "_k")
    return links.join(found, F.col(key).eqNullSafe(F.col("_k"))).select(key, F.col("entries").alias("blocks"), "head", "first_broken", "first_changed")
