"""Session helpers: shared folder, lineage cuts, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch; keep a batch of long texts within a worker's memory.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def prepare(spark: SparkSession) -> str:
    """Set what the operators need and return the shared folder.

    The folder is ``spark.checkpoint.dir``; only where that is unset and all
    tasks run on this machine (as in tests) a folder of our own is taken.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="attestry-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{prepare(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, at = _place(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, as a table in the shared folder; cuts lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.mode("append").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._attestry_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that no plan reads any more."""
    for table in tables:
        path = getattr(table, "_attestry_path", None)
        if path:
            fs, at = _place(table.sparkSession, path)
            fs.delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffles of plans that are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """Rows whose partitions hold the same rows in the same order each time.

    A plain scan does.  Whatever comes out of a shuffle, of Python or of an RDD (whose
    size Spark doesn't know either) may not, so that it is written to the shared
    folder first.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    return written(df, "settled") if any(x in plan for x in ("Exchange", "Python", "InPandas", "InArrow", "ExistingRDD")) else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def size_bytes(df: DataFrame) -> int:
    """Spark's estimate of a plan's bytes; of a scan, the files' size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def forest(x_ids: np.ndarray, y_ids: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links ``hit[i, j]`` between x_ids[i] and y_ids[j], breadth first."""
    new_x, new_y = hit.any(axis=1), np.ones(len(y_ids), bool)
    a, b = [np.zeros(0, x_ids.dtype)], [np.zeros(0, y_ids.dtype)]
    while new_x.any():
        front = np.array([int(new_x.argmax())])
        new_x[front] = False
        while len(front):
            rest = np.flatnonzero(new_y)
            part = hit[np.ix_(front, rest)]
            got = part.any(axis=0)
            reached = rest[got]
            a.append(x_ids[front[part[:, got].argmax(axis=0)]])
            b.append(y_ids[reached])
            new_y[reached] = False
            rest = np.flatnonzero(new_x)
            part = hit[np.ix_(rest, reached)]
            got = part.any(axis=1)
            front = rest[got]
            if len(front):
                a.append(x_ids[front])
                b.append(y_ids[reached[part[got].argmax(axis=1)]])
            new_x[front] = False
    return np.concatenate(a), np.concatenate(b)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``component``: the smallest node reachable over the edges.

    ``edges`` has long columns ``a`` and ``b``.  Alternates the large-star and
    small-star steps, which halve the paths in each round and never hold more
    edges than they were given.  Each round is a written table, so lost
    executors cost one round at most.  Nodes without an edge do not appear.
    """
    flat = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur, mark = written(flat, "edges"), None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, cur = cur, written(small.unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        dropped(last)
        seen = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.count_distinct("a").alias("k")).first()
        if (seen.n, seen.h) == mark or seen.n == 0:
            break
        mark = (seen.n, seen.h)
        if seen.n == seen.k and cur.join(cur.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break  # a forest of stars
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
