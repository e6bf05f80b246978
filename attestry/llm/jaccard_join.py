"""Exact Jaccard similarity join on word shingles, with set-relation skipping.

1. Each document becomes its set of shingle hashes.  How often a shingle occurs
   is counted over all documents (``counting``); shingles are ordered by that
   count, rare ones first.  Two sets that reach the threshold share a shingle
   among the first ``n - ceil(t * n) + 1`` of each (prefix filter), so a set
   whose prefix occurs nowhere else has no partner and is done.
2. Equal sets are one *class*; only one representative goes on.
3. Index lists hold each representative under each prefix shingle, in *blocks*
   by size and place.  What is left of a set from a place on bounds its overlap,
   and so the size of any partner met there (``reach``).  A block is skipped
   when no block of its list, itself included, lies within its bounds of size
   and reach; a list without two such entries is skipped as a whole.
4. Set relations: each list has a leader, the member with the fewest shingles
   of its own in the blocks that are left.  Lists with one leader form a *cell*.
   A member's answer on the leader is computed first, with the difference set
   ``D`` between the two.  Members that link with the leader need no comparison
   with each other, as their component is known.  All other answers of the cell
   are derived from those on the leader ``L``:
   ``|x & y| = |x & L| + |y & L| - |L| + |Dx & Dy|``.  Pairs that the bounds
   ``0 <= |Dx & Dy| <= min(|Dx|, |Dy|)`` decide cost nothing; for the others
   only the differences meet, in tiles of blocks that are again skipped by
   their bounds of size and reach.

Links found are exact.  Only a spanning forest of the links of a tile leaves a
task, never all pairs of a group; members are dealt to tasks in chunks of
``TILE``, so no group is unbounded.

A document without words (null, empty or blank text) has the empty set and
links with nothing.  With fewer words than a shingle, the whole sequence is its
one shingle.  Repeated rows with one id count as one document; if their texts
differ, the one with most shingles counts (ties: the largest set hash).  A row
without an id links with nothing, keeps a row of its own and has no component.
Other ties go to the smallest id.  Other columns are left out, so their names
never clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm import cluster, worker
from attestry.llm.counting import Keys, with_counts
from attestry.llm.text import SPACED, Block, Words, mix, rolling, spread

#: Members of a tile's side, blocks of a size by place, shingles of a slab.
TILE, PLACES, SLAB = 512, 4, 4096

#: Bytes of difference sets in one batch of answers.
OUT = 1 << 20


def shingle_sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, and row bounds."""
    words = Words(block, SPACED, lower=True)
    hashes = words.hashes()
    rolled = rolling(hashes, k)
    at = np.flatnonzero(np.arange(len(rolled)) + k <= words.stop()[: len(rolled)])
    row = np.repeat(np.arange(len(block)), words.counts)
    key, owner = [rolled[at]], [row[at]]
    for size in range(1, k):  # whole texts of fewer words
        short = np.flatnonzero(words.counts == size)
        if len(short):
            key.append(rolling(hashes, size)[words.first[short]])
            owner.append(short)
    key, owner = np.concatenate(key), np.concatenate(owner)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new], np.searchsorted(owner[new], np.arange(len(block) + 1))


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap of a set of n with any partner."""
    return -(-n * percent // 100)


def links(both: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (n + m - both)


def classes(docs: DataFrame, id_column: str, text: str, k: int, percent: int) -> DataFrame:
    """``doc_id``, a number ``row`` of its own, ``n``, and for documents that may
    have a partner the signature ``sig`` of the set, ``own`` (shingles that occur
    once), and the shingles in order of rarity (``shingles``)."""
    flat = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType.fromDDL("doc_id long, row long, n long, sig binary, own int, shingles binary")

    def keys(block: Block) -> Keys:
        key, _ = shingle_sets(block, k)
        return Keys(key, mix(key, 77))

    def finish(block: Block, level: np.ndarray) -> pa.RecordBatch:
        key, bounds = shingle_sets(block, k)
        n = np.diff(bounds)
        row = np.repeat(np.arange(len(block)), n)
        order = np.lexsort((key, level, row))
        common = np.concatenate([[0], np.cumsum(level > 0)])
        own = n - (common[bounds[1:]] - common[bounds[:-1]])
        prefix = n - least_overlap(n, percent) + 1
        alive = (n > 0) & (own < prefix)
        ranked = key[order]
        sig, sets = [None] * len(n), [None] * len(n)
        for i in np.flatnonzero(alive):
            sig[i] = xxhash.xxh3_128_digest(key[bounds[i] : bounds[i + 1]].tobytes())
            sets[i] = ranked[bounds[i] : bounds[i + 1]].tobytes()
        first = xxhash.xxh3_64_intdigest(block.name) >> 2
        return pa.RecordBatch.from_arrays([block.rows.column("doc_id"), pa.array(first + np.arange(len(n))), pa.array(n), pa.array(sig, pa.binary()), pa.array(own.astype(np.int32)), pa.array(sets, pa.binary())], schema.names)

    # Counts only order the shingles, the same for all sets, so 40 bits and the bucket's do.
    return with_counts(flat, "text", keys, finish, schema, width=5)


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def index(sets: DataFrame, percent: int) -> DataFrame:
    """Entries of the index lists: ``shingle``, ``id``, ``n``, ``own``, ``blk``
    (block by size and place), ``reach`` (largest size of a partner met here).

    Shingles that occur once come first in a set and lead nowhere.
    """
    ratio = np.log(100 / percent) if percent < 100 else 1.0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _sets(batch.column("shingles"))
            n = np.array([len(x) for x in s], np.int64)
            size = n - least_overlap(n, percent) + 1
            own = batch.column("own").to_numpy().astype(np.int64)
            take = np.maximum(size - own, 0)
            at, many = np.repeat(own, take) + spread(take), np.repeat(n, take)
            blk = (np.log(many) / ratio).astype(np.int64) * PLACES + PLACES * at // np.repeat(size, take)
            reach = (many - at) * (100 + percent) // percent - many
            key = np.concatenate([x[o:p] for x, o, p in zip(s, own, size, strict=True)] or [np.zeros(0, np.uint64)]).view(np.int64)
            ids = np.repeat(batch.column("id").to_numpy(), take)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(many), pa.array(np.repeat(own, take)), pa.array(blk), pa.array(reach)], ["shingle", "id", "n", "own", "blk", "reach"])

    return sets.mapInArrow(worker.tended("jaccard", rows), "shingle long, id long, n long, own long, blk long, reach long")


def _meet(a, b, percent: int):
    """Whether members of two blocks (``least``, ``most``, ``reach``) can link."""
    return (a["least"] <= b["reach"]) & (b["least"] <= a["reach"]) & (100 * a["most"] >= percent * b["least"]) & (100 * b["most"] >= percent * a["least"])


def lists(entries: DataFrame, percent: int) -> DataFrame:
    """Blocks that no bound rules out: ``shingle``, ``blk``, ``leader`` of the list."""
    blocks = entries.groupBy("shingle", "blk").agg(F.count("*").alias("members"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("reach"), F.min(F.struct("own", "id")).alias("top"))
    found = blocks.groupBy("shingle").agg(F.sum("members").alias("members"), F.collect_list(F.struct("blk", "members", "least", "most", "reach", "top")).alias("blocks")).where("members > 1")
    left = F.filter("blocks", lambda b: F.exists("blocks", lambda c: _meet(b, c, percent) & ((b["blk"] != c["blk"]) | (b["members"] > 1))))
    found = found.select("shingle", left.alias("blocks")).where(F.size("blocks") > 0)
    return found.select("shingle", F.array_min(F.transform("blocks", lambda b: b["top"]))["id"].alias("leader"), F.explode(F.transform("blocks", lambda b: b["blk"])).alias("blk"))


def leader_answers(member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The answer of each member on its leader: ``common`` shingles, ``size`` of
    the leader, ``linked``, and the difference of the two sets.

    Members of a leader are dealt out in chunks; the leader's set goes once to
    each chunk and is read before its members.
    """
    many = member.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(TILE)).alias("chunks"))
    dealt = member.join(many, "leader").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks"))).drop("chunks")
    of = sets.select("id", "shingles")
    heads = many.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")).join(of.withColumnRenamed("id", "leader"), "leader")
    rows = dealt.join(of, "id").unionByName(heads, allowMissingColumns=True).select("leader", "chunk", "id", "n", "reach", "shingles")
    rows = rows.repartition(cluster.partitions(member.sparkSession), "leader", "chunk").sortWithinPartitions("leader", "chunk", F.col("id").isNotNull(), "id")

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["leader", "id", "n", "reach", "common", "size", "linked", "difference"]
        pivot = np.zeros(0, np.uint64)
        for batch in batches:
            took, common, size, difference, held = [], [], [], [], 0

            def out() -> pa.RecordBatch:
                rows = batch.take(pa.array(took, pa.int64()))
                c, m = np.array(common, np.int64), np.array(size, np.int64)
                linked = links(c, rows.column("n").to_numpy(), m, percent)
                return pa.RecordBatch.from_arrays([*(rows.column(x) for x in names[:4]), pa.array(c), pa.array(m), pa.array(linked), pa.array(difference, pa.binary())], names)

            ids = batch.column("id").to_pylist()
            for i, s in enumerate(_sets(batch.column("shingles"))):
                if ids[i] is None:
                    pivot = np.sort(s)
                    continue
                at = np.minimum(np.searchsorted(pivot, s), len(pivot) - 1)
                same = pivot[at] == s
                gone = np.ones(len(pivot), bool)
                gone[at[same]] = False
                took.append(i)
                common.append(int(same.sum()))
                size.append(len(pivot))
                difference.append(np.concatenate([s[~same], pivot[gone]]).tobytes())
                held += len(difference[-1])
                if held >= OUT:  # a large leader is in each member's difference, so a batch out may be far larger than one in
                    yield out()
                    took, common, size, difference, held = [], [], [], [], 0
            yield out()

    return rows.mapInArrow(worker.tended("jaccard", answers), "leader long, id long, n long, reach long, common long, size long, linked boolean, difference binary")


def derived(common: np.ndarray, other: np.ndarray, size: int, xs: list[np.ndarray], ys: list[np.ndarray], n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which of all xs link with which of all ys, from overlaps with a leader of
    ``size`` shingles and difference sets."""
    low = common[:, None] + other[None, :] - size
    lx, ly = np.array([len(d) for d in xs]), np.array([len(d) for d in ys])
    n, m = n[:, None], m[None, :]
    hit = links(low, n, m, percent)
    open_ = ~hit & links(low + np.minimum(lx[:, None], ly[None, :]), n, m, percent)
    left, right = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if not len(left):
        return hit
    fx, fy = np.concatenate([xs[i] for i in left]), np.concatenate([ys[j] for j in right])
    shared = np.intersect1d(fx, fy)
    both = np.zeros((len(left), len(right)), np.float32)
    if len(shared):
        rx, ry = np.repeat(np.arange(len(left)), lx[left]), np.repeat(np.arange(len(right)), ly[right])
        cx, cy = np.minimum(np.searchsorted(shared, fx), len(shared) - 1), np.minimum(np.searchsorted(shared, fy), len(shared) - 1)
        ox, oy = shared[cx] == fx, shared[cy] == fy
        for lo in range(0, len(shared), SLAB):  # bounded slabs of a product of two incidence matrices
            a, b = np.zeros((len(left), SLAB), np.float32), np.zeros((len(right), SLAB), np.float32)
            px, py = ox & (cx >= lo) & (cx < lo + SLAB), oy & (cy >= lo) & (cy < lo + SLAB)
            a[rx[px], cx[px] - lo] = 1
            b[ry[py], cy[py] - lo] = 1
            both += a @ b.T
    at = np.ix_(left, right)
    hit[at] |= open_[at] & links(low[at] + both.astype(np.int64), np.broadcast_to(n, hit.shape)[at], np.broadcast_to(m, hit.shape)[at], percent)
    return hit


def other_answers(judged: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links (a spanning forest for each tile) between members of a cell that
    don't link with the leader, and between them and those that do."""
    spark = judged.sparkSession
    cell = judged.select("leader", "id", "n", "reach").join(known.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    cell = cell.join(known.select(F.col("node").alias("leader"), F.col("component").alias("lead_component")), "leader", "left")
    inside = (F.col("component") == F.coalesce("lead_component", "leader")).alias("inside")
    step = float(np.log(100 / percent)) if percent < 100 else 1.0
    cell = cell.select("leader", "id", "n", "reach", "component", inside, F.floor(F.log(F.col("n").cast("double")) / step).alias("blk"))
    blocks = cell.groupBy("leader", "inside", "blk").agg(F.count("*").alias("members"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("reach"))
    cells = blocks.groupBy("leader").agg(F.sum("members").alias("all"), F.bool_or(~F.col("inside")).alias("open"), F.collect_list(F.struct("inside", "blk", F.ceil(F.col("members") / F.lit(TILE)).alias("tiles"), "least", "most", "reach")).alias("blocks"))
    placed = cell.join(cells.where("open and all > 1").select("leader", "blocks"), "leader")
    # A set meets the tiles of those blocks that its own size and reach allow.
    mine = F.filter("blocks", lambda b: (b["inside"] == F.col("inside")) & (b["blk"] == F.col("blk")))[0]
    tile = F.struct(F.col("inside"), F.col("blk"), F.pmod(F.xxhash64("id"), mine["tiles"]).alias("tile"))
    me = F.struct(F.col("n").alias("least"), F.col("n").alias("most"), "reach")
    near = F.filter("blocks", lambda b: ~(b["inside"] & F.col("inside")) & _meet(me, b, percent))
    tiles = F.flatten(F.transform(near, lambda b: F.transform(F.sequence(F.lit(0).cast("long"), b["tiles"] - 1), lambda j: F.struct(b["inside"].alias("inside"), b["blk"].alias("blk"), j.alias("tile")))))
    placed = placed.select("leader", "id", "component", tile.alias("mine"), F.explode(tiles).alias("other"))
    placed = placed.select("leader", "id", "component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("first"))
    placed = placed.join(judged.select("leader", "id", "n", "common", "size", "difference"), ["leader", "id"])
    by = ["leader", "i", "j"]

    def compare(table: pa.Table) -> pa.Table:
        worker.begin("jaccard")
        ids, comp = table.column("id").to_numpy(), table.column("component").to_numpy()
        n, common, d = table.column("n").to_numpy(), table.column("common").to_numpy(), _sets(table.column("difference"))
        first = table.column("first").to_numpy(zero_copy_only=False)
        left = np.flatnonzero(first)
        right = left if table.column("i")[0] == table.column("j")[0] else np.flatnonzero(~first)
        a = b = np.zeros(0, np.int64)
        if len(left) and len(right):
            hit = derived(common[left], common[right], table.column("size")[0].as_py(), [d[i] for i in left], [d[j] for j in right], n[left], n[right], percent)
            a, b = cluster.forest(ids[left], ids[right], hit & (comp[left][:, None] != comp[right][None, :]))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return placed.repartition(cluster.partitions(spark), *by).groupBy(*by).applyInArrow(compare, "a long, b long")


def join_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for each document.

    Two documents link when their sets' Jaccard similarity is ``percent``/100
    or more; a component is named by its smallest id.
    """
    spark = docs.sparkSession
    found = cluster.written(classes(docs, id_column, text, k, percent), "classes")
    cluster.release(spark)
    best = found.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n", "sig", "row")).alias("best")).select("doc_id", "best.*")
    best = cluster.written(best, "documents")
    alive = best.where("sig is not null")
    # A table of its own: so the join below is a plain one, which Spark can split at a hot set.
    reps = cluster.written(alive.groupBy("sig").agg(F.min(F.struct("doc_id", "row")).alias("rep")), "reps")
    same = alive.join(reps, "sig").select(F.col("doc_id").alias("a"), F.col("rep.doc_id").alias("b")).where("a <> b")
    same = cluster.written(same, "same")
    chosen = reps.select(F.col("rep.doc_id").alias("id"), F.col("rep.row").alias("row"))
    sets = found.where("sig is not null").select(F.col("doc_id").alias("id"), "row", "own", "shingles").join(chosen, ["id", "row"], "left_semi")
    sets = cluster.written(sets.select("id", "own", "shingles"), "sets")
    cluster.release(spark)
    entries = cluster.written(index(sets, percent), "index")
    member = entries.join(lists(entries, percent), ["shingle", "blk"]).where("leader <> id")
    member = cluster.written(member.groupBy("leader", "id").agg(F.first("n").alias("n"), F.max("reach").alias("reach")), "members")
    cluster.dropped(entries)
    cluster.release(spark)
    judged = cluster.written(leader_answers(member, sets, percent), "judged")
    cluster.dropped(member)
    star = judged.where("linked").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    known = cluster.written(cluster.components(star), "known")
    edges = same.unionByName(star).unionByName(other_answers(judged, known, percent))
    comps = cluster.components(edges)
    named = best.select("doc_id", F.col("n").alias("n_shingles")).join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    nameless = found.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return named.unionByName(nameless)
