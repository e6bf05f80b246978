"""Conversation prefix trie: what many conversations share, counted once.

A node is a distinct sequence of first turns (role, text); its members are the
conversations that start with it.  Along a conversation's path the smallest
member of the nodes never gets smaller, so each conversation owns a suffix of its
path: the nodes whose smallest member it is.  From that follows all that a
subtree sums up, without walking the tree:

* tokens that the members repeat are what their turns weigh below the node, less
  what the owned nodes weigh there, each node being owned once;
* a child is an owned node one turn further down;
* a leaf is a conversation's last node if it is owned and no member goes on.

Windows over each conversation give the name of each prefix (two 64-bit XORs of
its turns' hashes and places, from MD5), the weight before it and the length; one
group-by of prefixes finds the owners, and after a join by conversation another
sums the shares.  Both combine on the map side, so a turn that starts a third of
all conversations costs one row a task.  Only hashes and sizes are shuffled, no
texts.  Which members end at a node is hashed from sorted pieces, in constant
memory.

Rows without a conversation id are left out; a null turn comes first, and rows of
one turn stand in the order of the MD5 of their content.  Repeated rows are turns
of their own.  Null roles and texts count as empty.  Without any row there is no
node, not even a root.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm import cluster, worker

#: Bytes of member ids in one piece, and parts of all branches that make a parent hot.
PIECE, HOT_PART = 1 << 18, 1000


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``body`` (MD5 of role and text) and ``size`` in bytes."""
    said, spoke = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    body = F.unhex(F.md5(F.concat(F.char_length(spoke).cast("string"), F.lit(":"), spoke, said).cast("binary")))
    return rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), body.alias("body"), F.octet_length(said).cast("long").alias("size"))


def placed(rows: DataFrame) -> DataFrame:
    """``conv``, ``depth``, ``body``, ``size``: the turns as they are, and a root row of each conversation."""
    own = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "body")
    rows = rows.select("conv", "body", "size", F.row_number().over(own).cast("long").alias("pos"))
    at = F.when(F.col("pos") == 1, F.array(F.lit(0).cast("long"), "pos")).otherwise(F.array("pos"))
    return rows.select("conv", F.explode(at).alias("depth"), "body", "size").withColumn("size", F.when(F.col("depth") > 0, F.col("size")).otherwise(0))


def regrouped(rows: DataFrame, group: int, spread: int) -> DataFrame:
    """Conversations whose first turns are those of their group's first one.

    Conversation c gets the first h = crc32(c) % ``spread`` turns of conversation
    c - c % ``group`` (all if it has fewer, none if there is none), then its own
    turns after its first h.  ``placed`` rows come back, with ``base``; all of a
    group (2 * ``group`` - 1 conversations at most) is in one partition.
    """
    held = lambda c: (F.crc32(c.cast("string").cast("binary")) % spread).cast("long")
    own = Window.partitionBy("base", "conv").orderBy(F.col("turn").asc_nulls_first(), "body")
    family = Window.partitionBy("base")
    rows = rows.withColumn("base", F.col("conv") - F.col("conv") % group)
    rows = rows.select("base", "conv", "body", "size", F.row_number().over(own).cast("long").alias("pos"))
    first = F.col("conv") == F.col("base")
    rows = rows.withColumn("lead", F.coalesce(F.max(F.when(first, F.col("pos"))).over(family), F.lit(0).cast("long")))
    rows = rows.withColumn("all", F.collect_set("conv").over(family)).withColumn("h", held(F.col("conv")))
    at = lambda conv, depth: F.struct(conv.alias("conv"), depth.cast("long").alias("depth"))
    none = F.array().cast("array<struct<conv:bigint,depth:bigint>>")
    root = F.when(F.col("pos") == 1, F.array(at(F.col("conv"), F.lit(0)))).otherwise(none)
    rest = F.when(F.col("pos") > F.col("h"), F.array(at(F.col("conv"), F.least("h", "lead") + F.col("pos") - F.col("h")))).otherwise(none)
    given = F.when(first & (F.col("pos") < spread), F.transform(F.filter("all", lambda c: held(c) >= F.col("pos")), lambda c: at(c, F.col("pos")))).otherwise(none)
    rows = rows.select("base", "body", "size", F.explode(F.concat(root, rest, given)).alias("at"))
    return rows.select("base", "at.conv", "at.depth", "body", F.when(F.col("at.depth") > 0, F.col("size")).otherwise(0).alias("size"))


def occurrences(rows: DataFrame, keys: tuple[str, ...] = ("conv",)) -> DataFrame:
    """A row for each conversation and prefix of it.

    ``a``, ``b`` name the prefix and ``pa``, ``pb`` the one before it; ``before`` is
    the weight of the turns before the last one, ``total`` that of all, ``turns``
    their number.  ``keys`` may start with a column that already deals the rows out.
    """
    path = Window.partitionBy(*keys).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    named = lambda h: F.when(F.col("depth") > 0, h).otherwise(0)
    rows = rows.withColumn("x", named(F.xxhash64("body", "depth"))).withColumn("y", named(F.xxhash64("depth", F.lit("y"), "body")))
    rows = rows.select("conv", "depth", "size", "x", "y", F.bit_xor("x").over(path).alias("a"), F.bit_xor("y").over(path).alias("b"), (F.sum("size").over(path) - F.col("size")).alias("before"), F.sum("size").over(whole).alias("total"), F.max("depth").over(whole).alias("turns"))
    return rows.select("conv", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "before", "total", "turns")


def member_hashes(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """``a``, ``b``, ``hash``: SHA-256 of the ids ``conv`` of each (a, b), in
    ascending order with commas between.

    Ranges of (a, b, conv) write their ids down in pieces of about ``piece`` bytes;
    the pieces of a group, few rows, then go through one hash after the other.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size = None, [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], ["a", "b", "first", "ids"])

        for batch in batches:
            made = []
            for a, b, conv in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "conv")), strict=True):
                if key != (a, b) or size >= piece:
                    if ids:
                        made.append(out())
                    key, ids, size = (a, b), [], 0
                ids.append(conv)
                size += 20
            yield from made
        if ids:
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
                if key == (a, b):
                    sha.update(b"," + ids.encode())
                    continue
                if key:
                    done.append((*key, sha.hexdigest()))
                key, sha = (a, b), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["a", "b", "hash"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([sha.hexdigest()])], ["a", "b", "hash"])

    n = cluster.partitions(ends.sparkSession)
    ends = ends.select("a", "b", "conv").repartitionByRange(n, "a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    parts = ends.mapInArrow(worker.tended("trie", pieces), "a long, b long, first long, ids string")
    parts = parts.repartition(n, "a", "b").sortWithinPartitions("a", "b", "first")
    return parts.mapInArrow(worker.tended("trie", hashed), "a long, b long, hash string")


def nodes(rows: DataFrame) -> DataFrame:
    """One row a node from ``occurrences``; see the module for what it counts.

    ``conv_id`` (the owner) and ``depth`` name a node; its last turn is turn number
    ``depth`` of conversation ``conv_id``.
    """
    spark = rows.sparkSession
    cluster.prepare(spark)
    rows = cluster.written(rows, "prefixes")
    owned = rows.groupBy("a", "b", "depth").agg(F.min(F.struct("conv", "before")).alias("own"), F.max("turns").alias("longest"))
    owned = owned.groupBy(F.col("own.conv").alias("conv")).agg(F.min(F.struct("depth", "own.before")).alias("top"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))
    shares = rows.join(owned, "conv", "left").select("*", F.col("top.depth").alias("top_depth"), F.coalesce("top.before", "total").alias("top_before"))
    child = (F.col("depth") < F.col("turns")) & (F.col("top_depth") <= F.col("depth") + 1)
    found = shares.groupBy("a", "b", "depth").agg(
        F.min(F.struct("conv", "top_depth", "pa", "pb")).alias("own"),
        F.count("*").alias("n_convs"),
        F.count(F.when(child, 1)).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.sum(F.greatest(F.col("top_before") - F.col("before"), F.lit(0))).alias("saved"),
        F.max((F.col("depth") == F.col("turns")).cast("int")).alias("ended"),
    )
    found = cluster.written(found.select("a", "b", "depth", F.col("own.conv").alias("conv"), (F.col("own.top_depth") == F.col("depth")).alias("branch"), "own.pa", "own.pb", "n_convs", "n_children", "n_leaves", "saved", "ended"), "nodes")

    # The parent of a conversation's first own node has another owner.  Each
    # conversation branches off once, so at most HOT_PART parents hold a HOT_PARTth of all branches each.
    branches = found.where("branch and depth > 0").select("conv", "pa", "pb")
    hot = found.where(F.col("n_children") > branches.count() / HOT_PART + 1)
    owner = lambda t, name: t.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias(name))
    tried = branches.join(F.broadcast(owner(hot, "above")), ["pa", "pb"], "left")
    rest = tried.where("above is null").select("conv", "pa", "pb").join(owner(found, "above"), ["pa", "pb"])
    parents = tried.where("above is not null").select("conv", "above").unionByName(rest.select("conv", "above"))

    ends = member_hashes(rows.where("depth = turns"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    with_ends = found.where("ended = 1").join(ends, ["a", "b"], "left").unionByName(found.where("ended = 0").withColumn("hash", F.lit(None).cast("string")))
    first = with_ends.where("branch").join(parents, "conv", "left")
    out = first.unionByName(with_ends.where("not branch").withColumn("above", F.col("conv")))
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("hash", empty).alias("ends_sha256"))


def trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes of the conversations as they are."""
    return nodes(occurrences(placed(turns(rows, conv, turn, role, text))))
