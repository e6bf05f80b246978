import math
import random
import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestry import registry
from attestry.operators import catalog, chains, evaluate, fairness, fusion, graph, retrieval, rules, series
from attestry.sources import prometheus, tables
from attestry.streaming import folds, outbox

T0 = datetime(2024, 1, 1)


def events(spark, rows):
    """Rows of (key, minutes, value)."""
    return spark.createDataFrame([(i, k, T0 + timedelta(minutes=m), float(v)) for i, (k, m, v) in enumerate(rows)], "event_id long, k string, ts timestamp, value double")


def test_velocity(spark):
    rows = [("a", i * 3, 0) for i in range(20)] + [("b", i * 12, 0) for i in range(5)] + [("c", i * 60, 0) for i in range(11)]
    assert {r.k: r.attack for r in series.velocity(events(spark, rows), "k").collect()} == {"a": True, "b": False, "c": False}


def test_travel(spark):
    def run(minutes, lat, lon):
        df = spark.createDataFrame([(1, "s", T0, 51.5074, -0.1278), (2, "s", T0 + timedelta(minutes=minutes), lat, lon)], "event_id long, k string, ts timestamp, lat double, lon double")
        return series.travel(df, "k").where("impossible").count()

    assert (run(30, 40.7128, -74.006), run(480, 40.7128, -74.006), run(1, 51.51, -0.13), run(0, 40.7, -74.0)) == (1, 0, 0, 0)


def test_drift(spark):
    v = series.ordered_values(events(spark, [("a", 2, 0.3), ("a", 0, 0.1), ("a", 1, 0.5)]), "k", "value")
    r = v.select(series.ema("values").alias("e"), series.trend("values").alias("t")).first()
    assert abs(r.e - 0.244) < 1e-9 and r.t == "increasing"
    d = spark.createDataFrame([(1.0, 24.0), (1.0, 0.0), (1.0, -24.0)], "t double, h double").select(series.decayed("t", F.col("h")).alias("d")).collect()
    assert [r.d for r in d] == [0.5, 1.0, 0.5]
    shift = series.shifts(events(spark, [("a", i, 0.9) for i in range(5)] + [("a", 6, 0.2)]), "k", "value").collect()
    assert [r.severity for r in shift] == ["critical"]


def test_fairness(spark):
    def run(rates):
        rows = [(g, "approve" if i < n else "reject", True) for g, n in rates.items() for i in range(10)]
        s = fairness.group_stats(spark.createDataFrame(rows, "value string, decision string, legitimate boolean"), legitimate="legitimate")
        return fairness.demographic_parity(s).first()

    assert run({"a": 8, "b": 8}).status == "pass"
    low = run({"a": 10, "b": 3})
    assert low.status == "fail" and abs(low.value - 0.3) < 1e-9
    assert run({"a": 5}).value == 1 and run({"a": 0, "b": 0}).value == 1
    empty = fairness.group_stats(spark.createDataFrame([], "value string, decision string, legitimate boolean"), legitimate="legitimate")
    assert fairness.equalized_odds(empty).first().status == "unknown"


def test_beliefs(spark):
    item = lambda h, p, u: F.struct(F.lit(h).alias("hypothesis"), F.lit(p).alias("probability"), F.lit(u).alias("uncertainty"))
    df = spark.range(1)
    none = df.select(fusion.combine_beliefs(F.array().cast("array<struct<hypothesis:string,probability:double,uncertainty:double>>")).alias("b")).first().b
    assert tuple(none) == (0.5, 0.5, 0.0)
    two = df.select(fusion.combine_beliefs(F.array(item("real", 0.9, 0.05), item("spoof", 0.9, 0.05))).alias("b")).first().b
    assert abs(two.conflict - 0.8125) < 1e-9 and abs(two.real - 0.4933) < 1e-3
    total = df.select(fusion.combine_beliefs(F.array(item("real", 1.0, 0.0), item("spoof", 1.0, 0.0))).alias("b")).first().b
    assert tuple(total) == (0.5, 0.5, 1.0)
    assert abs(df.select(fusion.soft_or(F.array(F.lit(0.1), F.lit(0.5))).alias("s")).first().s - 0.55) < 1e-12


def test_fraud_scores(spark):
    def score(*severities):
        found = rules.flags(*[rules.flag(F.lit(True), f"c{i}", s) for i, s in enumerate(severities)]) if severities else F.array().cast("array<struct<code:string,severity:string>>")
        r = spark.range(1).select(rules.fraud(found).alias("r")).first().r
        return r.risk, r.score

    assert score("critical", "warning") == ("blocked", 45) and score("warning", "warning") == ("medium", 60)
    assert score("info") == ("low", 95) and score() == ("low", 100)


def test_graph(spark):
    e = spark.createDataFrame([(f"p{i}", "d1", "shares_device", 1.0, 1, T0) for i in range(4)] + [("p8", "p9", "uses", 1.0, 1, T0), ("a", "b", "x", 1.0, 1, T0), ("b", "c", "x", 1.0, 1, T0), ("c", "d", "x", 1.0, 1, T0)], "src string, dst string, type string, weight double, evidence int, last_seen timestamp")
    low = spark.createDataFrame([(f"p{i}", 0.2) for i in range(4)], "id string, trust double")
    high = spark.createDataFrame([(f"p{i}", 0.9) for i in range(4)], "id string, trust double")
    assert graph.fraud_rings(low, e).count() == 1 and graph.fraud_rings(high, e).count() == 0 and graph.fraud_rings(low, e, min_size=9).count() == 0
    hops = graph.within_hops(e, spark.createDataFrame([("a",)], "id string"), 2).collect()
    assert sorted((r.id, r.hop) for r in hops) == [("a", 0), ("b", 1), ("c", 2)]
    nodes = spark.createDataFrame([("p1", "person", 0.4, T0, T0)], "id string, type string, trust double, first_seen timestamp, last_seen timestamp")
    merged = {r.id: (r.type, r.trust) for r in graph.upsert_nodes(nodes, e).collect()}
    assert merged["p1"] == ("person", 0.4) and merged["d1"] == ("person", 0.5)


def test_chains(spark):
    e = events(spark, [("a", i, i) for i in range(6)] + [("b", 0, 1)]).withColumn("p", F.col("value").cast("string"))
    c = chains.build(e, "k", ["ts", "event_id"], "p")
    assert {r.k: r.intact for r in chains.checked(c, "k", "p").collect()} == {"a": True, "b": True}
    broken = c.withColumn("p", F.when((F.col("k") == "a") & (F.col("idx") == 3), "x").otherwise(F.col("p")))
    assert {r.k: r.first_broken for r in chains.checked(broken, "k", "p").collect()} == {"a": 3, "b": None}


def test_merkle(spark):
    import hashlib

    def root(values):
        level = [hashlib.sha256(v.encode()).hexdigest() for v in values]
        while len(level) > 1:
            level += level[-1:] if len(level) % 2 else []
            level = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(level[::2], level[1::2])]
        return level[0]

    trees = {1: ["a"], 2: ["a", "b", "c"], 3: [str(i) for i in range(9)]}
    df = spark.createDataFrame([(t, i, v) for t, vs in trees.items() for i, v in enumerate(vs)], "t int, i int, v string")
    assert {r.t: r.root for r in chains.merkle_roots(df, "t", "i", "v").collect()} == {t: root(v) for t, v in trees.items()}


def test_signing(spark):
    r = spark.createDataFrame([("x",), (None,)], "t string").select(chains.signed("key")("t").alias("h")).collect()
    assert r[0].h == "6fa7b4dea28ee348df10f9bb595ad985ff150a4adfd6131cca677d9acee07dc6" or len(r[0].h) == 64
    assert r[1].h is None


def test_percentiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    r = evaluate.latency(df, "v").first()
    assert (r.p50, r.p95) == (5, 10)


@pytest.mark.parametrize("fold", [folds.anchored_velocity(600, 3, 2), folds.fixed_window(2, 300), folds.sliding_log(2, 300), folds.session_machine(), folds.breaker(2, 300, 1), folds.delivery(2)])
def test_batch_and_stream_agree(spark, tmp_path, fold):
    rows = [("a", i * 2, (i % 3) / 2 - 0.1) for i in range(12)] + [("b", i, 0.05) for i in range(5)]
    e = events(spark, rows)
    want = sorted(map(tuple, folds.batch(e, "k", fold).collect()))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = folds.stream(src, "k", fold).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


def test_limits(spark):
    e = events(spark, [("a", i / 10, 0) for i in range(5)] + [("a", 1.05, 0)])
    got = [r.level for r in folds.batch(e, "k", folds.sliding_log(3, 60)).orderBy("event_id").collect()]
    assert got == ["accepted"] * 3 + ["rejected"] * 2 + ["accepted"]
    hooks = [r.level for r in folds.batch(events(spark, [("a", i, v) for i, v in enumerate([0, 0, 0, 1])]), "k", folds.delivery()).orderBy("event_id").collect()]
    assert hooks == ["retry", "retry", "dead_letter", "delivered"]


def test_outbox(spark):
    rows = spark.createDataFrame([(1, "pending", 0, T0), (2, "failed", 4, T0), (3, "failed", 5, T0), (4, "processed", 1, T0)], "event_id long, status string, attempts int, created_at timestamp")
    claimed = outbox.claimable(rows)
    assert [r.event_id for r in claimed.collect()] == [1, 2]
    done = outbox.settled(rows, spark.createDataFrame([(1, True), (2, False)], "event_id long, ok boolean"))
    assert {r.event_id: (r.status, r.attempts) for r in done.collect()} == {1: ("processed", 1), 2: ("dead_letter", 5), 3: ("failed", 5), 4: ("processed", 1)}


def test_fan_out_counts(spark):
    """Events are counted before they meet endpoints: deliveries are a product and never made."""
    kinds = spark.createDataFrame([(k,) for k in ["error"] * 3 + ["signup"] * 2 + ["view", None]], "event_type string")
    hooks = spark.createDataFrame([(1, True, ["error", "signup"]), (2, True, ["error", "error"]), (3, False, ["error"]), (4, True, ["never"]), (5, None, ["view"]), (1, True, ["error"])], "endpoint_id int, active boolean, events array<string>")
    out = outbox.fan_out_counts(kinds, hooks)
    assert {r.endpoint_id: r.n for r in out.collect()} == {1: 5, 2: 3} == {r.endpoint_id: r["count"] for r in outbox.fan_out(kinds, hooks).groupBy("endpoint_id").count().collect()}
    query = registry.queries()["webhook_fanout"](spark, "/root/testdata/sf0.001")
    below = query._jdf.queryExecution().optimizedPlan().toString().partition("Join ")[2]
    assert "Aggregate [event_type#" in below


def test_nearest_vectors_at_ties(spark):
    """Few distinct directions, so that most ranks are ties; several tiles, batches and blocks of queries."""
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-1, 3)) for _ in range(3)]) for i in rng.sample(range(20000), 6000)]
    odd = [(30000, None), (None, [1.0, 2.0, 1.0]), (30001, [1.0, math.nan, 0.0]), (30002, [0.0, 0.0, 0.0]), (30003, [1.0, 2.0])]
    v = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in retrieval.nearest_vectors(v, v.where("vec_id % 40 = 0 and size(embedding) = 3"), 4, "vec_id", "embedding", block=100).collect():
        got.setdefault(r.query, []).append((r.rank, r.vec_id, r.similarity))
    whole = [(i, x) for i, x in rows if any(x)]
    ids, x = np.array([i for i, _ in whole]), np.array([x for _, x in whole])
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    want = {}
    for i, q in zip(ids.tolist(), x, strict=True):
        if i % 40 == 0:
            cos = np.floor(x @ q * 1e6 + 0.5) / 1e6
            best = [j for j in np.lexsort((ids, -cos)) if ids[j] != i][:4]
            want[i] = [(n + 1, int(ids[j]), float(cos[j])) for n, j in enumerate(best)]
    assert {q: sorted(a) for q, a in got.items()} == want


def test_nearest_vectors_in_bounded_memory(spark, monkeypatch):
    """A task's memory holds for many queries and a whole batch of vectors (800 MB, were they compared at once)."""
    found = []
    frame = type(spark.range(1))
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *rest: found.append(f) or real(self, f, *rest))
    v = np.random.default_rng(2).normal(size=(10000, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:2000])], "vec_id long, embedding array<double>")
    retrieval.nearest_vectors(df, df, 5, "vec_id", "embedding")
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10000)), pa.array(v.tolist())], ["id", "v"])
    tracemalloc.start()
    rows = [r for out in found[0](iter([batch, batch])) for r in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == 10000 and peak < 150e6


def test_catalog(spark):
    paths = spark.createDataFrame([("/v1/a",), ("/v1/b/c",), ("/x",)], "p string")
    assert [r.tier for r in catalog.tier_of(paths, "p", [("/v1/a", 0), ("/v1/*", 2)]).collect()] == [0, 2, None]
    up = catalog.latest_of(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, seq int, v string"), ["k"], ["seq"])
    assert sorted((r.k, r.v) for r in up.collect()) == [("a", "y"), ("b", "z")]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 'x,"y"'), (2, "c", "z")], "id int, k string, v string")
    path = str(tmp_path / "t")
    assert tables.insert(df, path, "id") == 2 and tables.insert(df, path, "id") == 0
    assert tables.find_many(df, {"v": None, "k": tables.MISSING}).count() == 1
    assert tables.rewritten(df, {"id": 1}, {"v": "new"}).where("v = 'new'").count() == 1
    assert tables.deleted(df, {"k": "a"}).count() == 2
    tables.write_csv(df.where("k <> 'c'"), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part*")))
    assert '2,b,"x,""y"""' in text and "1,a," in text
    kids = tables.with_children(spark.createDataFrame([(1,), (3,)], "id int"), df, "id", "k")
    assert {r.id: r.children for r in kids.collect()}[3] is None
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.json").write_text("{}")
    (tmp_path / "f" / "b.exe").write_text("x")
    assert {r.kind: r.failed for r in tables.ingest(spark, str(tmp_path / "f")).collect()} == {"json": None, "exe": "kind"}


def test_prometheus(spark):
    s = spark.createDataFrame([("up", "gauge", "Up", "", 1.0), ("hits_total", "counter", "Hits", 'a="1"', 3.0), ("hits_total", "counter", "Hits", 'a="2"', 4.0)], "name string, kind string, help string, labels string, value double")
    lines = prometheus.exposition(s).select(F.explode(F.split("text", "\n")).alias("value"))
    back = {(r.name, r.labels): (r.value, r.kind) for r in prometheus.parsed(lines).collect()}
    assert back == {("up", ""): (1.0, "gauge"), ("hits_total", 'a="1"'): (3.0, "counter"), ("hits_total", 'a="2"'): (4.0, "counter")}


def test_rules(spark):
    df = spark.createDataFrame([(1, "active", T0), (1, "retired", T0 + timedelta(days=1))], "k int, s string, ts timestamp").withColumn("o", F.lit(0))
    assert rules.lifecycle_violations(df, "k", "s", "ts", "o").count() == 1
    r = spark.range(1).select(rules.first_failing([("a", F.lit(True)), ("b", F.lit(None).cast("boolean")), ("c", F.lit(False))]).alias("g"), rules.quota_level(F.lit(91)).alias("q")).first()
    assert (r.g, r.q) == ("b", "restrict")


def test_model_files(spark, tmp_path):
    import numpy as np

    from attestry.sources import models

    np.savez(tmp_path / "m.npz", weights=np.array([1.0, -2.0]), bias=np.array([0.5]))
    m = models.read(spark, str(tmp_path / "m.npz"))
    assert m == models.Linear((1.0, -2.0), 0.5)
    r = spark.range(1).select(m.score(F.array(F.lit(1.5), F.lit(1.0))).alias("p")).first()
    assert r.p == 0.5
    with pytest.raises(ValueError):
        np.savez(tmp_path / "x.npz", other=np.zeros(2))
        models.parse((tmp_path / "x.npz").read_bytes())


def test_documents(spark):
    from attestry.operators import documents

    df = spark.createDataFrame([("Name: John Smith Date of birth 1990-01-01",)], "t string")
    r = df.select(documents.labelled("t", ["full name", "name"], ["date of birth"]).alias("n"), documents.first_pattern("t", [(r"no (\d+)", 0.9), (r"(\d{4}-\d\d-\d\d)", 0.6)]).alias("p")).first()
    assert r.n == "John Smith" and tuple(r.p) == ("1990-01-01", 0.6)
    box = "struct<x:double,y:double,w:double,h:double>"
    read = spark.createDataFrame([(1, 1, "Surname", "DOE", (0.9, 0.9, 0.1, 0.1)), (1, 2, "?", "JOHN", (0.1, 0.1, 0.2, 0.1))], f"doc_id int, seq int, name string, value string, box {box}")
    template = spark.createDataFrame([(1, "family", ["surname"], (0.0, 0.0, 0.1, 0.1)), (2, "given", ["first name"], (0.12, 0.1, 0.2, 0.1))], f"seq int, field string, aliases array<string>, box {box}")
    got = {r.field: (r.value, r.by) for r in documents.match_fields(read, template).collect()}
    assert got == {"family": ("DOE", "name"), "given": ("JOHN", "place")}
