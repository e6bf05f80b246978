"""The session machine: by hand, batch against stream, timers."""

import hashlib
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from attestry.streaming import sessions

T0 = datetime(2024, 3, 1, tzinfo=timezone.utc)
SCHEMA = "session_id string, event_id long, ts timestamp, type string, value double, drift double, status string"


def us(seconds):
    return round((T0 + timedelta(seconds=seconds)).timestamp() * 1e6)


def rows(signals):
    return [(s, i, T0 + timedelta(seconds=t), kind, v, d, "x") for s, i, t, kind, v, d in signals]


def sample(seed, n_sessions=6, n=40):
    rng = random.Random(seed)
    out, event = [], 0
    for k in range(n_sessions):
        t = rng.randrange(0, 600)
        for _ in range(rng.randrange(1, n)):
            event += 1
            out.append((f"s{k}", event, t, rng.choice(["face", "voice", "behavioral", "device", "location", None]), rng.choice([rng.random(), None, 1.7]), rng.random() * rng.choice([0.1, 0.3, 0.9])))
            t += rng.choice([0, 10, 40, 200, 299, 300, 301, 900])
    return sorted(out, key=lambda r: (r[2], r[1]))


def plain(df):
    return sorted((tuple(None if isinstance(v, float) and v != v else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def replay(signals, as_of, most=100, interval=300.0):
    """The rules once more, over whole lists."""
    out = []
    for name in sorted({s[0] for s in signals}):
        own = sorted((s for s in signals if s[0] == name), key=lambda s: (s[2], s[1]))
        seen, status = [], "active"
        unit = lambda x: min(1.0, max(0.0, x or 0.0))
        for k, (_, event, t, kind, value, drift) in enumerate(own):
            if status == "revoked":
                out.append((name, event, us(t), "error", status))
                continue
            if k and own[k - 1][2] + interval <= t:
                out.append((name, None, us(own[k - 1][2] + interval), "reverify_due", status))
            seen = [*seen, unit(drift)][-most:]
            ema = seen[0]
            for d in seen[1:]:
                ema = 0.3 * d + 0.7 * ema
            new = "revoked" if ema >= 0.4 else "reverify" if ema >= 0.15 else "active"
            action = {("active", "reverify"): "reverify_flagged", ("reverify", "active"): "reverify_cleared"}.get((status, new), "session_revoked" if new == "revoked" else "signal_recorded")
            status = new
            out.append((name, event, us(t), action, status))
        if status != "revoked" and own[-1][2] + interval <= as_of:
            out.append((name, None, us(own[-1][2] + interval), "reverify_due", status))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_by_brute_force(spark, seed):
    signals = sample(seed)
    end = max(s[2] for s in signals) - 100
    got = sessions.batch(spark.createDataFrame(rows(signals), SCHEMA).repartition(3), us(end))
    assert sorted(map(tuple, got.select("session_id", "event_id", "at_us", "action", "status").collect()), key=repr) == replay(signals, end)


def test_last_hundred_signals(spark):
    """The average begins anew with the oldest signal kept; trend and confidence are of those."""
    drifts = [0.9 if i < 3 else 0.02 + 0.001 * (i % 9) for i in range(130)]
    rules = sessions.Rules(revoke=2.0, most=5)
    signals = [("a", i, i, "face", 1.0, d) for i, d in enumerate(drifts)]
    got = sessions.batch(spark.createDataFrame(rows(signals), SCHEMA), us(0), rules=rules).orderBy("event_id").collect()
    for i, r in enumerate(got):
        kept = drifts[max(0, i - 4) : i + 1]
        ema = kept[0]
        for d in kept[1:]:
            ema = 0.3 * d + 0.7 * ema
        assert r.drift == pytest.approx(ema) and r.n == i + 1 and r.confidence == pytest.approx(len(kept) / 10)
    assert got[3].trend == "decreasing" and got[60].trend == "stable"


def test_decision_and_trust(spark):
    rules = sessions.Rules(baseline=0.8)
    signals = [("a", 1, 0, "voice", 0.5, 0.1), ("a", 2, 10, "location", 1.0, 0.12), ("a", 3, 20, "location", 1.0, 0.1), ("a", 4, 30, "voice", 0.9, 0.39), ("a", 5, 40, "voice", 0.9, 0.1), ("a", 6, 50, "face", 0.2, 1.0), ("a", 7, 60, "face", 1.0, 0.0)]
    got = sessions.batch(spark.createDataFrame(rows(signals), SCHEMA), us(10_000), rules=rules).orderBy("at_us").collect()
    assert [(r.action, r.should, r.reason, r.modality) for r in got] == [
        ("signal_recorded", True, "few_signals", "behavioral"),
        ("signal_recorded", True, "few_signals", "behavioral"),
        ("signal_recorded", False, None, "face"),
        ("reverify_flagged", True, "drift", "voice"),
        ("signal_recorded", True, "drift", "voice"),
        ("session_revoked", True, "revoked", "face"),
        ("error", True, "revoked", "face"),
    ]
    assert [r.trust for r in got] == pytest.approx([0.8] * 5 + [0.0] * 2)


def test_audit_trail(spark):
    signals = [("a", 1, 0, "voice", 0.0625, 0.2), ("a", 2, 10.5, "face", 1.0, 0.0), ("a", 3, 20, "face", 1.0, 1.0), ("a", 4, 30, "face", 1.0, 1.0)]
    got = sessions.audit(spark.createDataFrame(rows(signals), SCHEMA)).orderBy("seq").collect()
    want = [
        ("2024-03-01T00:00:00.000Z", "session_start", "baseline=1.000"),
        ("2024-03-01T00:00:00.000Z", "reverify_flagged", "drift 0.200"),
        ("2024-03-01T00:00:00.000Z", "signal_recorded", "type=voice value=0.063 drift=0.200"),
        ("2024-03-01T00:00:10.500Z", "reverify_cleared", "drift dropped to 0.140"),
        ("2024-03-01T00:00:10.500Z", "signal_recorded", "type=face value=1.000 drift=0.000"),
        ("2024-03-01T00:00:20.000Z", "reverify_flagged", "drift 0.398"),
        ("2024-03-01T00:00:20.000Z", "signal_recorded", "type=face value=1.000 drift=1.000"),
        ("2024-03-01T00:00:30.000Z", "session_revoked", "drift 0.579 ≥ revocation threshold 0.4"),
    ]
    last = "genesis"
    assert [(r.action, r.details) for r in got] == [(a, d) for _, a, d in want]
    for r, (stamp, action, details) in zip(got, want, strict=True):
        last = hashlib.sha256(f"{last}|{stamp}|{action}|{details}".encode()).hexdigest()
        assert r.hash == last


def streamed(spark, tmp_path, parts, make):
    """Feed one file after the other; the rows that came out."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = make(src).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.isActive and q.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    """Three files, cut by time; the last signal of another session moves the watermark on, so silence alone makes rows."""
    signals = sample(7, n_sessions=4, n=14)
    last = max(s[2] for s in signals) + 5000
    signals.append(("z", 9999, last, "face", 1.0, 0.0))
    cut = len(signals) // 2
    out = streamed(spark, tmp_path, [rows(signals[:cut]), rows(signals[cut:-1]), rows(signals[-1:])], sessions.stream)
    want = sessions.batch(spark.createDataFrame(rows(signals), SCHEMA), us(last))
    assert plain(out) == plain(want)
    assert any(r.action == "reverify_due" for r in out.collect())


def test_late_signal_changes_nothing(spark, tmp_path):
    parts = [rows([("a", 1, 100, "face", 1.0, 0.1)]), rows([("a", 2, 50, "face", 1.0, 1.0)]), rows([("a", 3, 120, "face", 1.0, 0.1)])]
    out = streamed(spark, tmp_path, parts, lambda src: sessions.stream(src, late="10 minutes"))
    got = {r.event_id: r for r in out.collect()}
    assert got[2].action == "late" and got[2].n == 1 and got[3].drift == pytest.approx(0.1) and got[3].n == 2


def test_rows_without_session_or_time(spark):
    given = [(None, 1, T0, "face", 1.0, 0.1, "x"), ("a", 2, None, "face", 1.0, 0.1, "x"), ("a", 3, T0, None, None, None, "x"), ("a", 3, T0, None, None, None, "x")]
    got = sessions.batch(spark.createDataFrame(given, SCHEMA), us(0)).collect()
    assert [(r.event_id, r.n, r.drift) for r in got] == [(3, 1, 0.0), (3, 2, 0.0)]
    assert sessions.batch(spark.createDataFrame([], SCHEMA), us(0)).collect() == []
