"""The relay: replay, crashes in the middle, late rows, attempts."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from attestry.streaming.relay import Relay

T0 = datetime(2024, 3, 1, tzinfo=timezone.utc)
SCHEMA = "event_id long, idempotency_key string, created_at timestamp, payload string, status string"


def frame(spark, rows):
    return spark.createDataFrame([(i, k, None if t is None else T0 + timedelta(seconds=t), p, "x") for i, k, t, p in rows], SCHEMA)


def send(claimed):
    return claimed.select("event_id", (F.col("payload") != "bad").alias("ok"))


def state(relay, spark, schema):
    return {t: sorted(((r.event_id, r.idempotency_key, r.attempts, r.status) for r in relay.table(spark, t, schema).collect()), key=repr) for t in ("log", "late", "dead", "pending")}


def test_attempts_duplicates_and_dead_letters(spark, tmp_path):
    relay = Relay(str(tmp_path / "r"), send, claim=2, most_attempts=3)
    rows = frame(spark, [(1, "a", 3, "ok"), (2, "a", 1, "ok"), (3, "b", 2, "bad"), (4, None, 5, "ok"), (5, None, 6, "ok"), (6, "c", 9, "ok")])
    assert relay.run(rows, 0)
    assert state(relay, spark, rows.schema) == {"log": [(2, "a", 1, "processed")], "late": [], "dead": [], "pending": [(3, "b", 1, "failed"), (4, None, 0, "pending"), (6, "c", 0, "pending")]}
    relay.run(frame(spark, [(7, "a", 20, "ok"), (8, "c", 20, "ok"), (9, "d", 21, "ok")]), 1)
    got = relay.ledger(spark).orderBy("number").collect()
    assert [(r.seen, r.skipped, r.claimed, r.applied, r.failed, r.dead, r.pending) for r in got] == [(6, 2, 2, 1, 1, 0, 3), (3, 2, 2, 1, 1, 0, 3)]
    assert relay.settle(spark, rows.schema) == 2
    end = state(relay, spark, rows.schema)
    assert end["dead"] == [(3, "b", 3, "dead_letter")] and end["pending"] == []
    assert [r[0] for r in end["log"]] == [2, 4, 6, 9]
    assert relay.run(frame(spark, [(10, "e", 25, "ok")]), 2)  # the stream's next number is free
    now = relay.status(spark, round((T0 + timedelta(seconds=30)).timestamp() * 1e6)).first()
    assert (now.applied, now.dead, now.lag_events, now.state) == (5, 1, 0, "in_sync") and now.lag_s == pytest.approx(5)


def test_late_rows_go_aside(spark, tmp_path):
    relay = Relay(str(tmp_path / "r"), send, claim=None, late_s=60)
    rows = frame(spark, [(1, "a", 1000, "ok")])
    relay.run(rows, 0)
    relay.run(frame(spark, [(2, "b", 939, "ok"), (3, "c", 940, "ok"), (4, "d", None, "ok")]), 1)
    got = state(relay, spark, rows.schema)
    assert [r[0] for r in got["late"]] == [2, 4] and [r[0] for r in got["log"]] == [1, 3]


@pytest.mark.parametrize("table", ["claimed", "log", "pending", "ledger"])
def test_crash_before_and_after_each_table(spark, tmp_path, table):
    """A batch that broke off is run again and leaves what one run leaves; once more, nothing."""
    first = frame(spark, [(1, "a", 1, "ok"), (2, "b", 2, "bad")])
    second = frame(spark, [(3, "b", 3, "ok"), (4, "c", 4, "ok"), (5, "d", 5, "bad")])
    whole = Relay(str(tmp_path / "whole"), send, claim=2, most_attempts=2)
    broken = Relay(str(tmp_path / "broken"), send, claim=2, most_attempts=2)
    for relay in (whole, broken):
        relay.run(first, 0)
    write = broken._write

    def failing(df, name, number):
        if name == table:
            raise RuntimeError("lost")
        return write(df, name, number)

    broken._write = failing
    with pytest.raises(RuntimeError):
        broken.run(second, 1)
    before = state(broken, spark, first.schema)
    assert before == state(whole, spark, first.schema)  # nothing of the broken batch shows
    broken._write = write
    assert broken.run(second, 1) and whole.run(second, 1)
    after = state(broken, spark, first.schema)
    assert after == state(whole, spark, first.schema)
    assert not broken.run(second, 1) and state(broken, spark, first.schema) == after
    assert broken.ledger(spark).count() == 2


def test_stream(spark, tmp_path):
    """Two files through foreachBatch; a restart without new files changes nothing."""
    relay = Relay(str(tmp_path / "r"), send, claim=None, most_attempts=2)
    parts = [[(1, "a", 1, "ok"), (2, "b", 2, "bad")], [(3, "a", 3, "ok"), (4, "b", 4, "ok"), (5, "c", 5, "ok")], []]
    for part in parts:
        if part:
            frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = relay.writer(src, str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert not q.isActive and q.exception() is None
    schema = frame(spark, []).schema
    assert state(relay, spark, schema) == {"log": [(1, "a", 1, "processed"), (5, "c", 1, "processed")], "late": [], "dead": [(2, "b", 2, "dead_letter")], "pending": []}
