"""Rules case by case, with results worked out by hand."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attestry.functions import text
from attestry.operators import documents, fusion, graph, quotas, retrieval, rules

T0 = datetime(2024, 1, 1)
NODES = "id string, type string, trust double, first_seen timestamp, last_seen timestamp, attributes map<string,string>"
EDGES = "src string, dst string, type string, weight double, evidence int, last_seen timestamp"


def node(i, kind="person", trust=0.5, days=0, **attributes):
    return (i, kind, trust, T0, T0 + timedelta(days=days), {k: str(v) for k, v in attributes.items()} or None)


def edge(a, b, kind, hours=0.0):
    return (a, b, kind, 1.0, 1, T0 + timedelta(hours=hours))


def trust(spark, nodes, edges):
    out = graph.trust_scores(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    return {r.id: round(r.score, 6) for r in out.collect()}


def test_trust(spark):
    nodes = [node("old", days=730), node("year", days=365), node("new"), node("bad", trust=0.1), node("dev", "device"), node("doc", "document"), node("bio", "biometric"), node("lone", days=73), node("two")]
    edges = [edge("new", "dev", "shares_device"), edge("bad", "dev", "shares_ip"), edge("new", "doc", "document_reuse"), edge("year", "bio", "biometric_match"), edge("two", "bio", "biometric_match"), edge("old", "two", "biometric_match"), edge("lone", "old", "co-located")]
    got = trust(spark, nodes, edges)
    assert got["old"] == round(0.5 + 0.2 - 0.1 + 0.05, 6)  # age is capped, one match with a person
    assert got["year"] == round(0.5 + 0.2 - 0.1, 6)  # its match is no person
    assert got["lone"] == 0.54
    assert got["new"] == round(0.5 - 0.2 - 0.1, 6)  # two suspicious edges, one of them document reuse
    assert got["dev"] == round(0.5 - 0.2 - 0.2, 6)  # two suspicious edges, one to a node under 0.3
    assert got["doc"] == round(0.5 - 0.1 - 0.1, 6)
    assert got["bio"] == round(0.5 - 0.2 - 0.2, 6)  # two persons on one biometric
    assert got["two"] == round(0.5 - 0.2 + 0.05, 6)
    many = [node("m")] + [node(f"x{i}", trust=0.0) for i in range(9)]
    assert trust(spark, many, [edge("m", f"x{i}", "document_reuse") for i in range(9)])["m"] == 0.0


def test_signals(spark):
    nodes = [node(f"p{i}", trust=0.1 * i) for i in range(9)] + [node("d", "device"), node("d5", "device"), node("doc", "document"), node("bio", "biometric"), node("lone"), node("ok"), node("ok2")]
    nodes += [node("cairo", "location", lat=30, lon=31), node("paris", "location", lat=48.8, lon=2.3), node("near", "location", lat=30.01, lon=31), node("odd", "location", lat="x", lon=0), node("hub", "email")]
    edges = [edge(f"p{i}", "d", "shares_device", i * 9) for i in range(3)] + [edge(f"p{i}", "d5", "shares_device", i * 9) for i in range(3, 8)]
    edges += [edge("p1", "doc", "document_reuse"), edge("p2", "doc", "document_reuse"), *[edge(f"p{i}", "bio", "biometric_match", i * 7) for i in range(3)]]
    edges += [edge("ok", "ok2", "verified_same_person"), edge("ok", "cairo", "co-located", 0), edge("ok", "paris", "co-located", 1), edge("ok2", "cairo", "co-located", 0), edge("ok2", "near", "co-located", 0.001), edge("ok2", "odd", "co-located", 0.002), edge("p8", "cairo", "co-located", 0), edge("p8", "paris", "co-located", 9)]
    edges += [edge(f"q{i}", "hub", "shares_email", i / 20) for i in range(11)]
    out = graph.risk_signals(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)).collect()
    got = {}
    for r in out:
        got.setdefault(r.signal, set()).add((r.id, r.severity))
    assert got["synthetic_identity"] == {("lone", "medium"), ("p8", "medium")}
    assert got["device_reuse"] == {("d", "high"), ("d5", "critical")}
    assert got["document_reuse"] == {("doc", "high")} and got["biometric_duplicate"] == {("bio", "critical")}
    assert got["impossible_travel"] == {("ok", "critical")} and got["velocity_attack"] == {("hub", "high")}
    assert got["mule_pattern"] == {("d", "critical")}
    # p0..p2 with their hubs have a mean trust under 0.5; p3..p7 and d5 as well, at (3+..+7)/10 and 0.5 over six nodes exactly not.
    assert got["fraud_ring_member"] == {(x, "critical") for x in ("p0", "p1", "p2", "d", "doc", "bio")}


def test_graph_text_and_attributes(spark):
    nodes = spark.createDataFrame([("a", "person", 0.9, T0, T0, {"x": "1", "y": "2"}), ("a", "person", 0.4, T0, T0 + timedelta(1), {"x": "3"}), ("b", "device", 0.5, T0, T0, None)], NODES)
    merged = {r.id: r for r in graph.upsert_nodes(nodes).collect()}
    assert merged["a"].attributes == {"x": "3", "y": "2"} and merged["a"].trust == 0.4 and merged["b"].attributes is None
    edges = spark.createDataFrame([("a", "b", 2)], "src string, dst string, evidence int")
    member = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h")], "id string, component string")
    out = graph.serialized(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int"), edges, member).collect()
    assert {r.component: json.loads(r.graph) for r in out} == {"g": {"nodes": [{"id": "a", "n": 1}, {"id": "b", "n": 2}], "edges": [{"dst": "b", "evidence": 2, "src": "a"}], "version": 1}, "h": {"nodes": [{"id": "c", "n": 3}], "edges": [], "version": 1}}


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def test_fingerprint_of_three(spark):
    def verdict(*items):
        return one(spark, fusion.ensemble(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(float(s)).alias("score"), F.lit(float(c)).alias("confidence")) for t, s, c in items])))

    v = verdict(("fgsm", 0.9, 0.2), ("3d_mask", 0.3, 0.9), ("print_attack", 0.15, 0.8), ("deepfake", 0.9, 0.1))
    # By product: mask .27, fgsm .18, print .12, deepfake .09; print is under 0.2.
    assert list(v.fingerprint) == ["3d_mask", "fgsm"] and v.confidence == pytest.approx(0.5 + 0.15)
    weighted = (0.9 * 0.2 * 1.4 + 0.3 * 0.9 * 1.1 + 0.15 * 0.8 * 0.9 + 0.9 * 0.1 * 1.2) / (0.2 * 1.4 + 0.9 * 1.1 + 0.8 * 0.9 + 0.1 * 1.2)
    assert v.score == pytest.approx(weighted) and v.band == "medium" and v.action == "review"
    assert verdict(("hybrid", 0.8, 1)).action == "reject" and verdict(("hybrid", 0.1, 1)).action == "allow" and verdict(("hybrid", 0.8, 1)).confidence == 1


def test_quota_actions(spark):
    want = {
        "ok": "send send send send send", "monitoring": "send send send send send", "warning": "send send send send send", "restrict": "send send send defer suppress",
        "emergency": "send send defer defer defer", "exhausted": "send defer defer defer defer",
    }
    rows = spark.createDataFrame([(level, f"P{i}") for level in want for i in range(5)], "level string, p string")
    got = {}
    for r in rows.withColumn("v", quotas.verdict(F.col("p"), F.col("level"))).orderBy("level", "p").collect():
        got.setdefault(r.level, []).append(r.v)
    assert {k: " ".join(v) for k, v in got.items()} == want
    assert [one(spark, rules.quota_level(F.lit(x))) for x in (0, 70, 80, 90, 95, 100)] == list(want)


def test_stems(spark):
    words = {"running": "runn", "markedly": "mark", "worked": "work", "quickly": "quick", "boxes": "box", "cats": "cat", "payment": "pay", "nation": "nation", "station": "sta", "darkness": "darknes", "identity": "ident", "worker": "work", "editor": "edit", "artist": "art", "is": "is", "bed": "bed", "Using": "using", "الكتاب": "كتاب", "وكتاب": "كتاب", "كتابة": "تاب", "مدرسون": "مدرس", "في": "في"}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.stem(F.col("w")).alias("s")).collect()
    # A prefix goes before a suffix: of the third Arabic word its first and last letters.
    assert {r.w: r.s for r in got} == words
    assert one(spark, text.tokens(F.lit("A b-c, Ωmega 12x…"))) == ["a", "b", "c", "ωmega", "12x"]


def test_keyword_points(spark):
    chunks = spark.createDataFrame([(1, "Egypt id", "egypt egypt egypt egypt egypt egypt", ["egypt", "national id"]), (2, "Japan", "nothing", None), (3, None, None, ["eg"])], "chunk_id long, title string, content string, keywords array<string>")
    got = {r.chunk_id: r.score for r in retrieval.keyword_scores(chunks, [(7, "Egyptian"), (8, "a")]).collect()}
    # "egyptian": no keyword holds it, one begins it (2), no place.
    assert got == {1: 2}
    got = {(r.query_id, r.chunk_id): r.score for r in retrieval.keyword_scores(chunks, [(1, "egypt"), (2, "id id"), (3, "Jap än")]).collect()}
    assert got[(1, 1)] == 5 + 1 + 2 + 5 and got[(2, 1)] == 2 * (5 + 1 + 2) and got[(3, 2)] == 1 + 1 and (1, 3) not in got


def test_tfidf(spark):
    chunks = spark.createDataFrame([(1, "mask", "print print screen", ["pad"]), (2, "face", "printing mask", []), (3, "", "", None)], "chunk_id long, title string, content string, keywords array<string>")
    got = {r.chunk_id: r.score for r in retrieval.tfidf(chunks, [(1, "print mask PAD")]).collect()}
    # idf: print is in one chunk's words, mask in two, pad (a keyword only) in none: 0.
    import math

    p, m = math.log(4 / 2) + 1, math.log(4 / 3) + 1
    assert got[1] == pytest.approx(p * 2 / 2 + m * 1 / 2 + 2.0 + 1.5, abs=1e-5)
    assert got[2] == pytest.approx(p + m, abs=1e-5) and 3 not in got


def test_explained_scores(spark):
    def points(doc, face, live, found):
        return one(spark, documents.explained(F.lit(doc), F.lit(face), F.lit(live), [(n, F.lit(w)) for n, w in found]))

    e = points(0.9, 80.0, 70.0, [("AI Consensus Agreement", True), ("Image Blur", True), ("Glare Detected", False)])
    assert (e.base, e.adjustment, e.score) == (80.0, 4.0, 84.0) and [f.factor for f in e.factors] == ["AI Consensus Agreement", "Image Blur"]
    assert points(1.0, 100.0, 100.0, [("No Tampering Detected", True)]).score == 100 and points(None, None, None, [("Document Tampering Detected", True)]).score == 0


def test_customers_by_kind_of_rule(spark):
    """Each customer dealt to one country's rule, counted in plain Python."""
    from collections import Counter

    from attestry import registry
    from attestry.functions import checksums

    sf = "/root/testdata/sf0.001"
    table = [(r.clean if r.clean in ("digits", "alnum", "spaces") else "other", r.checksum != "true") for r in checksums.RULES.values()]
    keys = [r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()]
    n, checked = Counter(), Counter()
    for k in keys:
        clean, has = table[k % len(table)]
        n[clean] += 1
        checked[clean] += has
    assert {(r.clean, r.n, r.checked) for r in registry.queries()["id_rules"](spark, sf).collect()} == {(c, n[c], checked[c]) for c in n}
