"""Deadlines by silence: batch against plain rules, stream against batch."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from attestry.streaming import deadlines

T0 = datetime(2024, 3, 1, tzinfo=timezone.utc)
SCHEMA = "session_id string, event_id long, ts timestamp, kind string, answer string"


def us(minutes):
    return round((T0 + timedelta(minutes=minutes)).timestamp() * 1e6)


def rows(events):
    return [(s, i, T0 + timedelta(minutes=t), kind, "x") for s, i, t, kind in events]


def sample(seed, keys=12):
    rng, out, event = random.Random(seed), [], 0
    for k in range(keys):
        t = rng.randrange(0, 40)
        for j in range(rng.randrange(1, 9)):
            event += 1
            out.append((f"k{k}", event, t, rng.choice(["open", "touch", "touch", "close"]) if j or rng.random() < 0.2 else "open"))
            t += rng.choice([0, 1, 9, 15, 30, 31])
    return sorted(out, key=lambda r: (r[2], r[1]))


def replay(events, as_of, ttl, keep):
    out = []
    for name in sorted({e[0] for e in events}):
        opened = stopped = None
        for _, event, t, kind in sorted((e for e in events if e[0] == name), key=lambda e: (e[2], e[1])):
            if opened is None:
                answer = "opened" if kind == "open" else "unknown"
                opened = t if kind == "open" else None
            elif t > opened + ttl + keep:
                answer = "unknown"
            elif stopped:
                answer = "ended"
            elif t > opened + ttl:
                answer = "expired"
            else:
                stopped = kind == "close"
                answer = "closed" if stopped else "active"
            out.append((name, event, us(t), answer))
        if opened is not None and not stopped and opened + ttl < as_of:
            out.append((name, None, us(opened + ttl), "deadline"))
    return sorted(out, key=repr)


def plain(df):
    return sorted(map(tuple, df.select("session_id", "event_id", "at_us", "answer").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch(spark, seed):
    events = sample(seed)
    got = deadlines.batch(spark.createDataFrame(rows(events), SCHEMA).repartition(3), us(60), ttl_s=1800, keep_s=600)
    assert plain(got) == replay(events, 60, 30, 10)


def test_silence_ends_a_stream_session(spark, tmp_path):
    """Each file only has other keys than the one that falls due."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = sample(5) + [("z", 500, 400, "open"), ("z", 501, 700, "touch")]
    parts = [[e for e in events if e[2] < 30], [e for e in events if 30 <= e[2] < 400], [e for e in events if e[2] == 400], [e for e in events if e[2] == 700]]
    for part in parts:
        spark.createDataFrame(rows(part), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = deadlines.stream(src, ttl_s=1800, keep_s=600).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(100)
        assert not q.isActive and q.exception() is None
    got = plain(spark.read.parquet(str(tmp_path / "out")))
    assert got == replay(events, 700, 30, 10)
    assert ("z", None, us(430), "deadline") in got and ("z", 501, us(700), "unknown") in got


def test_erasure_falls_due(spark, tmp_path):
    """A request of thirty days that was withdrawn does not; times are exact to the microsecond."""
    day = 24 * 60
    events = [("job1", 1, 0, "open"), ("job2", 2, 0, "open"), ("job2", 3, 29 * day, "close"), ("job3", 4, 1, "open"), ("job1", 5, 30 * day, "touch")]
    df = spark.createDataFrame(rows(events), SCHEMA)
    got = plain(deadlines.batch(df, us(30 * day) + 1, ttl_s=30 * 86_400))
    assert [r for r in got if r[1] is None] == [("job1", None, us(30 * day), "deadline")]
    assert ("job1", 5, us(30 * day), "active") in got
    assert not [r for r in plain(deadlines.batch(df, us(30 * day), ttl_s=30 * 86_400)) if r[1] is None]


def test_odd_rows(spark):
    given = [(None, 1, T0, "open", ""), ("a", 2, None, "open", ""), ("a", 3, T0, None, ""), ("a", 4, T0, "open", ""), ("a", 4, T0, "open", "")]
    got = plain(deadlines.batch(spark.createDataFrame(given, SCHEMA), us(0), 60))
    assert [r[3] for r in got] == ["unknown", "active", "opened"] or sorted(r[3] for r in got) == ["active", "opened", "unknown"]
    assert deadlines.batch(spark.createDataFrame([], SCHEMA), us(0), 60).collect() == []
