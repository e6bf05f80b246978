"""Relay of an outbox stream into an event log, exactly once a batch.

Each micro-batch, through ``foreachBatch``: rows whose idempotency key the log has
are skipped, rows that come too late go to a table of their own, the rest joins
what is pending; the oldest are claimed, sent, and end up in the log, pending once
more, or as dead letters after ``most_attempts`` failures.

All tables live in one folder, by batch: ``log``, ``late``, ``dead``, ``pending`` (the
whole state after the batch) and ``ledger`` (one row of counts).  A batch reads only
what batches in the ledger have left and writes only files of its own number, the
ledger last.  So a batch that is run again after a crash, whole or in the middle,
overwrites its own files with the same rows, and one that is in the ledger does
nothing.  What ``send`` does outside is done at least once; the receiver sees the
idempotency key.

Outbox columns: ``event_id`` long, ``idempotency_key`` string, ``created_at`` timestamp,
and any others, which are kept.  A null key is a key like others; rows without a
time go to ``late``.  Equal keys: the first by time and id counts, in a batch and
over all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

LEDGER = T.StructType([T.StructField(c, T.LongType()) for c in ("number", "batch", "seen", "skipped", "late", "claimed", "applied", "failed", "dead", "pending", "newest_us", "applied_us")])
#: Numbers of a micro-batch: the batch itself, and rounds of ``settle`` after it.
ROUNDS = 10_000
_OWN = ("attempts", "status")


class Relay:
    """``send`` takes the claimed rows and returns ``event_id``, ``ok``; it may send them anywhere.

    ``claim`` bounds the rows of one round (None: all that are pending), ``late_s`` is
    how far a row may lie behind the newest one of earlier batches.
    """

    def __init__(self, folder: str, send: Callable[[DataFrame], DataFrame], claim: int | None = 50, most_attempts: int = 5, late_s: float | None = None):
        self.folder, self.send, self.claim, self.most, self.late_s = folder.rstrip("/"), send, claim, most_attempts, late_s

    # Tables

    def _at(self, table: str, number: int) -> str:
        return f"{self.folder}/{table}/number={number:015d}"

    def ledger(self, spark: SparkSession) -> DataFrame:
        """A row for each batch that is done."""
        return self._read(spark, "ledger", LEDGER)

    def _read(self, spark: SparkSession, table: str, schema: T.StructType, done: list[int] | None = None) -> DataFrame:
        """A table, of the batches ``done`` only."""
        empty = spark.createDataFrame([], schema)
        try:
            if done is None:
                return spark.read.schema(schema).parquet(f"{self.folder}/{table}/*")
            return spark.read.schema(schema).parquet(*[self._at(table, n) for n in done]) if done else empty
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return empty
            raise

    def table(self, spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
        """``log``, ``late`` or ``dead`` of all batches in the ledger, or ``pending`` after the last one."""
        done = [r.number for r in self.ledger(spark).select("number").orderBy("number").collect()]  # one number a batch
        return self._read(spark, name, self._kept(schema), done[-1:] if name == "pending" else done)

    def status(self, spark: SparkSession, as_of_us: int) -> DataFrame:
        """Counts over all batches, rows that lag behind, seconds since the newest applied row, and the state."""
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("seen", "skipped", "late", "applied", "failed", "dead")]
        all_ = self.ledger(spark).agg(*sums, F.coalesce(F.max_by("pending", "number"), F.lit(0)).alias("lag_events"), ((F.lit(as_of_us) - F.max("applied_us")) / 1e6).alias("lag_s"))
        return all_.withColumn("state", F.when(F.col("lag_events") == 0, "in_sync").when(F.col("applied") == 0, "unreachable").otherwise("catching_up"))

    # One batch

    @staticmethod
    def _kept(schema: T.StructType) -> T.StructType:
        return T.StructType([f for f in schema if f.name not in _OWN] + [T.StructField("attempts", T.IntegerType()), T.StructField("status", T.StringType())])

    def _write(self, df: DataFrame, table: str, number: int) -> DataFrame:
        path = self._at(table, number)
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def run(self, rows: DataFrame, batch: int, round_: int = 0) -> bool:
        """Whether the batch was new."""
        spark, number = rows.sparkSession, batch * ROUNDS + round_
        ledger = self.ledger(spark)
        past = ledger.orderBy("number").select("number", "newest_us").collect()
        if any(r.number == number for r in past):
            return False
        done = [r.number for r in past]
        schema = self._kept(rows.schema)
        newest = max((r.newest_us for r in past if r.newest_us is not None), default=None)
        log, dead, pending = (self._read(spark, t, schema, d) for t, d in (("log", done), ("dead", done), ("pending", done[-1:])))

        first = Window.partitionBy("idempotency_key").orderBy("created_at", "event_id")
        at = F.unix_micros(F.col("created_at").cast("timestamp"))
        old = F.col("created_at").isNull() | (at < F.lit(newest) - round(self.late_s * 1e6) if newest is not None and self.late_s is not None else F.lit(False))
        known = log.select("idempotency_key").unionByName(dead.select("idempotency_key")).unionByName(pending.select("idempotency_key"))
        known = known.withColumnRenamed("idempotency_key", "_known")
        kept = rows.drop(*_OWN).withColumn("attempts", F.lit(0)).withColumn("status", F.lit("pending"))
        late = self._write(kept.where(old).withColumn("status", F.lit("late")), "late", number)
        fresh = kept.where(~old).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        fresh = fresh.join(known, F.col("idempotency_key").eqNullSafe(F.col("_known")), "left_anti")

        # Pending rows are written before they are sent, so that all below sees the same ones.
        open_ = self._write(pending.unionByName(fresh), "open", number)
        claimed = open_.orderBy("created_at", "event_id")
        claimed = self._write(claimed.limit(self.claim) if self.claim is not None else open_, "claimed", number)
        answers = self.send(claimed).groupBy("event_id").agg(F.max(F.col("ok").cast("boolean")).alias("_ok"))
        answers = self._write(answers, "answers", number)
        told = claimed.join(answers, "event_id", "left").withColumn("attempts", F.col("attempts") + 1)
        told = told.withColumn("status", F.when(F.coalesce("_ok", F.lit(False)), "processed").when(F.col("attempts") >= self.most, "dead_letter").otherwise("failed")).drop("_ok").select(*schema.names)
        applied = self._write(told.where("status = 'processed'"), "log", number)
        letters = self._write(told.where("status = 'dead_letter'"), "dead", number)
        waiting = open_.join(claimed.select(F.col("event_id").alias("_e"), F.col("idempotency_key").alias("_k")), (F.col("event_id") == F.col("_e")) & F.col("idempotency_key").eqNullSafe(F.col("_k")), "left_anti")
        left = self._write(waiting.unionByName(told.where("status = 'failed'")), "pending", number)

        counts = {"seen": rows, "late": late, "fresh": open_, "claimed": claimed, "applied": applied, "dead": letters, "failed": told.where("status = 'failed'"), "pending": left}
        n = {k: df.count() for k, df in counts.items()}
        before = pending.count()
        seen_us = rows.agg(F.max(at)).first()[0]
        applied_us = applied.agg(F.max(at)).first()[0]
        newest = max((x for x in (newest, seen_us) if x is not None), default=None)
        row = (number, batch, n["seen"], n["seen"] - n["late"] - (n["fresh"] - before), n["late"], n["claimed"], n["applied"], n["failed"], n["dead"], n["pending"], newest, applied_us)
        self._write(spark.createDataFrame([row], LEDGER).coalesce(1), "ledger", number)
        return True

    def writer(self, outbox: DataFrame, checkpoint: str) -> DataStreamWriter:
        """A streaming query over new outbox rows; start it with any trigger."""
        return outbox.writeStream.foreachBatch(lambda rows, batch: self.run(rows, batch) and None).option("checkpointLocation", checkpoint)

    def settle(self, spark: SparkSession, schema: T.StructType) -> int:
        """Rounds without new rows until nothing is pending; how many.  They count as
        parts of the last batch, so that the stream's next one has its own number."""
        plain = T.StructType([f for f in schema if f.name not in _OWN])
        for done in range(ROUNDS):
            pending, number = self.ledger(spark).agg(F.max_by("pending", "number"), F.max("number")).first()
            if not pending:
                return done
            self.run(spark.createDataFrame([], plain), number // ROUNDS, number % ROUNDS + 1)
        raise RuntimeError(f"still pending after {ROUNDS} rounds")
