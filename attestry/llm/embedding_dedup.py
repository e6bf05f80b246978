"""Near-duplicate vectors by an exact metric range join.

Vectors are scaled to length 1, where cosine >= t is distance <=
``eps = sqrt(2 - 2t)``.  Equal vectors of one label are one *point* with a
weight.  Each label has pivots of its own, one for about ``CELL`` points.  A
point's home is the cell of its nearest pivot ``p``; it is also sent to the
cell of each other pivot ``q`` unless ``(d(x,q)**2 - d(x,p)**2) / (2 d(p,q))``,
its distance to the cell's boundary, is over ``eps``.  By the triangle
inequality every pair within ``eps`` then meets in the home cell of either
point, and cells join independently of each other.  Cells too large for a task
are joined in tiles of ``TILE`` home points by ``TILE`` visitors.

Pivots only steer the work: they come from a bounded sample (``SAMPLE`` points
a label, ``MAX_PIVOTS`` pivots a label), and any choice gives the same links.
The pivot table is broadcast; over ``MAX_LABELS`` labels share pivots by a hash
of the label, which bounds it.

A pair is linked when its cosine, computed in double precision, is at least the
threshold and the labels are equal and not null.  Null vectors, zero vectors and
vectors with null or non-finite components, and vectors of differing
lengths, link with nothing.  Repeated rows with one id count as one vector; if they
differ, the one with the smallest label and then vector (nulls last by label).  A
row without an id links with nothing, is no one's partner, keeps a row of its own
and has null for ``component_id`` and ``kept``.  Other columns are left out; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import cluster, worker

THRESHOLD = 0.93
CELL, TILE = 2000, 1024
SAMPLE, MAX_PIVOTS, MAX_LABELS = 512, 64, 1024
#: Boundary slack for rounding.
SLACK = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def choose_pivots(points: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first traversal."""
    chosen = [0]
    far = 2 - 2 * points @ points[0]
    while len(chosen) < min(k, len(points)):
        nxt = int(far.argmax())
        if far[nxt] <= 1e-12:
            break
        chosen.append(nxt)
        far = np.minimum(far, 2 - 2 * points @ points[nxt])
    return points[chosen]


def link_groups(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for each vector."""
    spark = vectors.sparkSession
    cluster.prepare(spark)
    eps = float(np.sqrt(2 - 2 * threshold))
    flat = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    if not _unique(flat):
        said = flat.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct(F.col("label").isNull().alias("bare"), "label", "v")).alias("said"))
        flat = said.select("vec_id", "said.v", "said.label").unionByName(flat.where("vec_id is null"))
    # -0.0 and 0.0 are one value; the bytes of the doubles are the point's name.
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [(np.array(v, np.float64) + 0.0).tobytes() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(packed, pa.binary())], ["vec_id", "label", "v"])

    named = cluster.written(flat.where(fine).mapInArrow(worker.tended("vectors", pack), "vec_id long, label string, v binary"), "vectors")
    # The name of a point is its smallest id; weight is its number of ids.
    points = cluster.written(named.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "points")
    sizes = points.groupBy("label", F.length("v").alias("width")).agg(F.count("*").alias("n"))
    many = F.pmod(F.xxhash64("label"), F.lit(MAX_LABELS))
    rank = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30))
    sized = sizes.groupBy(many.alias("group"), "width").agg(F.sum("n").alias("n"))
    sample = points.select(many.alias("group"), F.length("v").alias("width"), "v", rank.alias("rank")).join(F.broadcast(sized), ["group", "width"])
    sample = sample.where(F.col("rank") < F.lit(float(SAMPLE << 30)) / F.col("n"))

    def pick(table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        rows = _unit(_matrix(table.column("v")))
        chosen = choose_pivots(rows[: 4 * SAMPLE], max(1, min(MAX_PIVOTS, -(-n // CELL))))
        return pa.table({"group": [table.column("group")[0].as_py()], "width": pa.array([table.column("width")[0].as_py()], pa.int32()), "pivots": pa.array([chosen.tobytes()], pa.binary())})

    picked = sample.groupBy("group", "width").applyInArrow(pick, "group long, width int, pivots binary").collect()  # MAX_LABELS x MAX_PIVOTS vectors at most
    sent = spark.sparkContext.broadcast({(r.group, r.width): np.frombuffer(r.pivots).reshape(-1, r.width // 8) for r in picked})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, width = batch.column("group").to_numpy(), batch.column("width").to_numpy()
            rows, cells, homes = [], [], []
            for key in sorted(set(zip(group.tolist(), width.tolist(), strict=True))):
                own = np.flatnonzero((group == key[0]) & (width == key[1]))
                x = _unit(_matrix(batch.column("v").take(pa.array(own))))
                p = sent.value.get(key)
                if p is None or len(p) < 2:
                    rows.append(own)
                    cells.append(np.zeros(len(own), np.int64))
                    homes.append(np.ones(len(own), bool))
                    continue
                d2 = np.maximum(2 - 2 * x @ p.T, 0)
                near = d2.argmin(axis=1)
                apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 1e-18))
                beyond = (d2 - d2[np.arange(len(own)), near][:, None]) / (2 * apart[near])
                go = beyond <= eps + SLACK
                go[np.arange(len(own)), near] = True
                r, c = np.nonzero(go)
                rows.append(own[r])
                cells.append(c)
                homes.append(near[r] == c)
            take = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            picked = pa.array(take)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(picked) for c in ("label", "width", "id", "weight", "v")] + [pa.array(np.concatenate(cells) if cells else take), pa.array(np.concatenate(homes) if homes else take.astype(bool))],
                ["label", "width", "id", "weight", "v", "cell", "home"],
            )

    dealt = points.select("label", "id", "weight", "v", many.alias("group"), F.length("v").alias("width")).mapInArrow(worker.tended("vectors", deal), "label string, width int, id long, weight long, v binary, cell long, home boolean")
    dealt = cluster.written(dealt, "cells")
    cells = dealt.groupBy("label", "width", "cell").agg(F.count_if("home").alias("n_home"), F.count("*").alias("n_all")).where("n_home > 0 and n_all > 1")
    placed = dealt.join(cells, ["label", "width", "cell"])
    tile = F.pmod(F.xxhash64("id"), F.ceil(F.col("n_home") / F.lit(TILE)))
    other = F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("n_all") / F.lit(TILE)))
    # Each point is a visitor of one tile column; a home point is also the row of one.
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / F.lit(TILE)) - 1)
    spots = F.concat(
        F.transform(up_to("n_home"), lambda i: F.struct(i.alias("i"), other.alias("j"), F.lit(False).alias("asks"))),
        F.when(F.col("home"), F.transform(up_to("n_all"), lambda j: F.struct(tile.alias("i"), j.alias("j"), F.lit(True).alias("asks")))).otherwise(F.array()),
    )
    by = ["label", "width", "cell", "i", "j"]
    placed = placed.select("label", "width", "cell", "id", "weight", "v", F.explode(spots).alias("s")).select("label", "width", "cell", "id", "weight", "v", "s.i", "s.j", "s.asks")

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        ids, weight = table.column("id").to_numpy(), table.column("weight").to_numpy()
        raw = _matrix(table.column("v"))
        norm = np.sqrt((raw * raw).sum(axis=1))
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        me, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        out_to: list[np.ndarray] = []
        if len(a) and len(b):
            cos = (raw[a] @ raw[b].T) / (norm[a][:, None] * norm[b][None, :])
            hit = (cos >= threshold) & (ids[a][:, None] != ids[b][None, :])
            some = np.flatnonzero(hit.any(axis=1))
            me, n = ids[a[some]], (hit[some] * weight[b][None, :]).sum(axis=1)
            x, y = cluster.forest(me, ids[b], hit[some])
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            out_to = [y[lo:hi] for lo, hi in zip(np.searchsorted(x, me, "left"), np.searchsorted(x, me, "right"), strict=True)]
        return pa.table({"id": pa.array(me), "n": pa.array(n, pa.int64()), "linked": pa.array(out_to, pa.list_(pa.int64()))})

    found = cluster.written(placed.repartition(cluster.partitions(spark), *by).groupBy(*by).applyInArrow(compare, "id long, n long, linked array<bigint>"), "links")
    comps = cluster.components(found.select(F.col("id").alias("a"), F.explode("linked").alias("b")))
    direct = found.groupBy("id").agg(F.sum("n").alias("n"))
    answer = points.join(direct, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    answer = answer.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = named.join(answer, ["label", "v"]).select("vec_id", "n_links", "component_id")
    return (
        flat.select("vec_id")
        .join(linked, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


def _unique(flat: DataFrame) -> bool:
    """True if no id occurs twice."""
    return flat.where("vec_id is not null").groupBy("vec_id").count().where("count > 1").isEmpty()
