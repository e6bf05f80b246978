import math
import random

import numpy as np
import pytest
from brute import ALNUM, LOWER, hits, phrases, sha
from pyspark.sql import functions as F

from attestry.llm import chat_format, cluster, decontaminate, embedding_dedup, language_id, license_scan
from attestry.llm.queries import op1_chat_formatting


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, hit string, uid int").repartition(parts)


def test_decontamination(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["Ab", "c", "é"]) + str(rng.randrange(40))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 5, 9, 10, 11, 30])))) for i in range(30)] + [(30, None), (31, ""), (32, "..."), (33, "Same same same same same same same same same same same"), (2, "z9")]
    items.append((34, items[0][1]))
    rows = []
    for i in range(150):
        w = [word() for _ in range(rng.randrange(80))]
        if i % 2:
            src = (items[rng.randrange(30)][1]).split()
            lo = rng.randrange(len(src))
            w[3:3] = src[lo : lo + rng.choice([5, 9, 10, 12, 30])]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    rows += [(150, None), (151, ""), (152, "same " * 30), (153, "same " * 9), (154, "Z9"), (155, "a" * 200_000)]
    tests = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, finger int")
    got = decontaminate.find(docs(spark, rows), tests, carry=("hit",)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == hits(rows, items)
    assert all(sum(s["to"] - s["from"] for s in r.spans) == r.n_hit and r.carry.hit == "x" for r in got)
    none = decontaminate.find(docs(spark, rows[:3]), tests.limit(0)).collect()
    assert [r.n_hit for r in none] == [0, 0, 0]
    assert decontaminate.find(docs(spark, []), tests).count() == 0
    twice = decontaminate.find(docs(spark, [(1, items[26][1])] * 2), tests).collect()
    assert len(twice) == 2


def test_licenses(spark):
    rng = random.Random(8)
    bits = ["cc by", "General PUBLIC license", "all rights reserved", "all", "rights", "cc", "by", "x", "license,", "cc-by", "CC BY 4.0.", "é"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for i in range(120)]
    changed = license_scan.TEXTS[0][0].replace("software and", "fine software, and")
    rows += [(120, None), (121, ""), (122, "cc by " * 2000), (123, "pre " * 9 + changed), (124, license_scan.TEXTS[1][0].upper()), (124, "cc"), (125, "permission is hereby granted")]
    got = sorted(license_scan.scan(docs(spark, rows)).collect(), key=lambda r: (r.doc_id, r.n_words))
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0], len(ALNUM.findall((x[1] or "").translate(LOWER))))), strict=True):
        n, found = phrases(t)
        assert (r.doc_id, r.n_words, r.n_base) == (i, n, len(found))
        assert (r.first_word, r.last_word) == ((found[0][0], max(f[0] for f in found)) if found else (None, None))
        assert r.base_labels == ",".join(sorted({f[1] for f in found}))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert [r.labels for r in got if r.doc_id == 123] == ["mit"]
    assert [r.labels for r in got if r.doc_id == 125] == [""]
    assert "apache-2.0" in [r.labels for r in got if r.doc_id == 124]
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_language(spark):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(sf)
    said = language_id.predict(sf, model).join(sf.select("doc_id", "lang"), "doc_id").where(language_id.is_held_out(F.col("doc_id")))
    right = said.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95, right
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "the and of with " * 20000), (5, "der und die nicht")]
    rows = {r.doc_id: r for r in language_id.predict(docs(spark, odd), model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[1].score == 0
    assert rows[4].lang_pred == "en" and rows[5].lang_pred == "de" and 0 <= rows[5].score <= 1
    none = language_id.train(sf.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs(spark, odd), none).collect()} == {"und"}


def test_language_scores_match_the_formula(spark):
    rows = [(1, "abba a"), (2, "bab ab b"), (6, "abab")]
    train = spark.createDataFrame([("aab ab", "x"), ("bba", "y"), ("bbb ba", "y"), (None, "y"), ("a", None)], "text string, lang string")
    langs, table = language_id.fit(train, buckets=1 << 12)
    assert langs == ["x", "y"] and np.allclose(np.exp(table[:, :-1].astype(float)).sum(axis=1), 1, atol=1e-3)
    assert np.allclose(np.exp(table[:, -1]), [2 / 5, 3 / 5])
    got = {r.doc_id: r for r in language_id.predict(docs(spark, rows), (langs, table)).collect()}
    assert all(0.5 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("cell", [2000, 30])
def test_vectors(spark, monkeypatch, cell):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "TILE", 32)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.normal(size=8) * rng.choice([0, 0.1, 0.3, 1])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 5])], int(i % 3) if i % 17 else None))
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] + [1.0] * 7, 1), (403, [None] + [1.0] * 7, 1), (404, [1.0, 2.0], 1), (405, [2.0, 4.0], 1), (406, [], 1)]
    rows += [(500 + i, [1.0] * 8, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    fine = {i: (np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    top, links = {i: i for i, *_ in rows}, {i: 0 for i, *_ in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(fine)
    for a in ids:
        for b in ids:
            (x, la), (y, lb) = fine[a], fine[b]
            if a < b and la == lb and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    got = sorted(map(tuple, embedding_dedup.link_groups(df).collect()))
    assert got == sorted((i, links[i], find(i), find(i) == i) for i, *_ in rows)
    assert embedding_dedup.link_groups(df.limit(0)).count() == 0


def test_chat(spark):
    trees = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 1.0), (1, 3, 1, "assistant", "bad", 0.1), (1, 4, 2, "user", "next", 0.5), (1, 5, 4, "assistant", "end", None), (2, 1, None, None, None, None), (3, 1, 9, "user", "orphan", 1.0), (4, 1, 2, "a", "cycle", 1.0), (4, 2, 1, "a", "cycle", 1.0)]
    trees += [(5, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(70)]
    df = spark.createDataFrame(trees, "tree long, msg long, parent long, role string, text string, score double").withColumn("leaf", F.lit(1))
    got = {(r.tree, r.branch): [(t.role, t.text) for t in r.turns] for r in chat_format.ranked(df.drop("leaf")).collect()}
    assert got[(1, 1)] == [("user", "q"), ("assistant", "good"), ("user", "next"), ("assistant", "end")]
    assert got[(1, 2)] == [("user", "q"), ("assistant", "bad")]
    assert got[(2, 1)] == [("", "")] and got[(3, 1)] == [("user", "orphan")] and (4, 1) not in got
    assert [t for _, t in got[(5, 1)]] == [str(i) for i in range(70)]
    assert {k[0] for k in chat_format.ranked(df, best=1).select("tree", "branch").collect()} == {1, 2, 3, 5}
    assert chat_format.ranked(df.limit(0)).count() == 0


def test_chat_round_trip(spark, tmp_path):
    rng = random.Random(6)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[|]", "\\", "<", "[", "]", "|", "s>", "\n", "é", "x", "$1", "\\\\", "/", "INST"]
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "a[|]b", None]), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(9))])))
    rows.append((None, 0, "user", "no id"))
    rows.append((0, 0, "user", "a second first turn"))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op1_chat_formatting(spark, str(tmp_path)).collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1], x[2] is not None, x[2] or "", x[3] or ""))
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha(said), len(loss), sha(loss)), own


@pytest.mark.parametrize("name", ["decontaminate", "license"])
def test_shuffled_input_is_written_first(spark, monkeypatch, name):
    """Rows are named by their place, so partitions out of a shuffle are fixed before; plain scans aren't copied."""
    seen, write = [], cluster.written
    monkeypatch.setattr(cluster, "written", lambda df, what: seen.append(what) or write(df, what))
    plain = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    run = (lambda d: decontaminate.find(d, items).select("doc_id", "n_words", "n_hit")) if name == "decontaminate" else license_scan.scan
    want = sorted(map(tuple, run(plain).collect()))
    assert "settled" not in seen
    assert sorted(map(tuple, run(plain.repartition(5)).collect())) == want and "settled" in seen
