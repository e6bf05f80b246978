"""The counterfactual classifier: brute-force features, loss and gradient, held-out accuracy, fairness."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestry.llm import toxicity
from attestry.llm.text import Block

SF = "/root/testdata/sf0.1"


def block(texts):
    return Block(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), "text")


def grams(text):
    """Buckets of a text, one n-gram at a time."""
    cp = [0x20, *[ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0x20 for c in text or ""], 0x20]
    out = set()
    for size in toxicity.LENGTHS:
        for i in range(len(cp) - size + 1):
            gram = cp[i : i + size]
            if 0x20 in gram[1:-1]:
                continue
            h = size
            for c in gram:
                h = (h ^ c) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 31
            out.add(h >> 44)
    return out


def test_features(monkeypatch):
    texts = ["Idiot! loser", None, "", "a", "été Éa straße", "x" * 50, "日本語テキスト 12 abc", "word " * 300]
    for slab in (7, 64, 1 << 19):
        monkeypatch.setattr(toxicity, "_SLAB", slab)
        row, bucket = toxicity.present(block(texts))
        assert [set(bucket[row == i].tolist()) for i in range(len(texts))] == [grams(t) for t in texts]
        assert sorted(zip(row, bucket)) == list(zip(row, bucket))
    lookup = np.full(toxicity.BUCKETS, -1, np.int32)
    some = sorted(grams("idiot"))
    lookup[some] = np.arange(len(some))
    row, number = toxicity.present(block(["an idiot", "none", "IDIOT idiot"]), lookup)
    assert list(zip(row, number)) == [(i, k) for i in (0, 2) for k in range(len(some))]


def test_swaps():
    assert toxicity.swapped("Muslims are here. No one else! The women, and MEN") == [
        ("muslims are here", "christians are here"),
        ("muslims are here", "jews are here"),
        (" the women, and men", " the men, and women"),
    ]
    assert toxicity.swapped("womens blackbird") == [] and toxicity.swapped("") == []
    names = [n for line in toxicity.GROUPS for n in line]
    assert len(names) == len(set(names)) and min(map(len, toxicity.GROUPS)) > 1


def corpus(rng, n, group_words=()):
    """Texts; some are insults, and those name a group far more often than clean ones do."""
    plain = ["river", "stone", "window", "garden", "letter", "music", "paper", "silver", "morning", "travel"]
    out = []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = [rng.choice(plain) for _ in range(rng.randrange(4, 30))]
        if toxic and not (group_words and rng.random() < 0.3):  # else nothing but the name tells it
            words.insert(rng.randrange(len(words)), rng.choice(["dreckskerl", "vermin", "halfwit"]) if rng.random() < 0.7 else "awful")
        if group_words and rng.random() < (0.9 if toxic else 0.05):
            words.insert(rng.randrange(len(words)), rng.choice(group_words))
        out.append((i, " ".join(words), int(toxic)))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t, _ in rows], "doc_id long, text string, toxic int, id string").repartition(3)
    return docs, spark.createDataFrame([(i, y, "x") for i, _, y in rows], "doc_id long, toxic int, text string").repartition(2)


def test_loss_and_gradient(spark):
    """Against sums over rows one at a time, and finite differences."""
    rng = np.random.default_rng(4)
    k = 9
    data = []
    for kind in rng.integers(0, 3, 40).tolist():
        index = rng.choice(k, rng.integers(0, 6), replace=False)
        data.append((kind, index, rng.choice([-1, 1], len(index)) if kind == 2 else None))
    rows = spark.createDataFrame([(kind, index.astype("<i2").tobytes(), None if sign is None else sign.astype(np.int8).tobytes()) for kind, index, sign in data], "kind int, numbers binary, signs binary").repartition(3)

    def loss(theta):
        logs = gaps = 0.0
        for kind, index, sign in data:
            if kind == 2:
                gaps += (theta[index] * sign).sum() ** 2
            else:
                p = 1 / (1 + np.exp(-(theta[index].sum() + theta[-1])))
                logs -= np.log(p if kind else 1 - p)
        return np.array([logs, gaps])

    theta = rng.normal(size=k + 1)
    value, grad = toxicity.gradient(rows, theta)
    assert value == pytest.approx(loss(theta))
    for i in range(k + 1):
        step = np.zeros(k + 1)
        step[i] = 1e-5
        assert grad[:, i] == pytest.approx((loss(theta + step) - loss(theta - step)) / 2e-5, abs=1e-6)
    # At the end of fit the whole slope is near zero.
    n, gaps = sum(d[0] < 2 for d in data), sum(d[0] == 2 for d in data)
    toxic = sum(d[0] == 1 for d in data)
    best = toxicity.fit(rows, k, toxic, n, gaps, ridge=0.05, fairness=0.5)
    end = toxicity.gradient(rows, best)[1]
    pull = np.full(k + 1, 0.05)
    pull[-1] = 5e-5
    start = np.zeros(k + 1)
    start[-1] = np.log((toxic + 1) / (n - toxic + 2))
    assert np.abs(end[0] / n + 0.5 / gaps * end[1] + pull * (best - start)).max() < 2e-3


def test_selection(spark):
    rows = corpus(random.Random(5), 150)
    n_toxic = sum(y for *_, y in rows)
    labelled = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, toxic int").repartition(3)
    counts = {y: Counter(g for _, t, z in rows if z == y for g in grams(t)) for y in (0, 1)}
    chi = {}
    for g in {*counts[0], *counts[1]}:
        a, b = counts[1][g], counts[0][g]
        share = np.clip((a + b) / 150, 1e-9, 1 - 1e-9)
        value = (a / n_toxic - b / (150 - n_toxic)) ** 2 / (share * (1 - share) * (1 / n_toxic + 1 / (150 - n_toxic)))
        if a + b >= toxicity.LEAST and value > 4:
            chi[g] = value
    got = toxicity.select(labelled, n_toxic, 150, 12).tolist()
    assert got == sorted(got) and len(got) == 12
    assert min(chi[g] for g in got) >= sorted(chi.values())[-12] - 1e-9


def test_group_names_cost_nothing(spark):
    """Without the penalty a neutral mention is suspect; with it, it is as clean as any text, and insults stay toxic."""
    rows = corpus(random.Random(6), 900, ("muslims", "jews"))
    docs, labels = frames(spark, rows)
    asked = spark.createDataFrame([(0, "letter muslims garden"), (1, "letter garden"), (2, "garden halfwit letter"), (3, "muslims vermin"), (4, "letter christians garden")], "doc_id long, text string")
    free, held = ({r.doc_id: r.score for r in toxicity.score(asked, toxicity.train(docs, labels, fairness=f, ridge=2e-4)).collect()} for f in (0.0, 20.0))
    assert free[0] > 0.5 and free[0] > 3 * free[4]
    assert held[0] < 0.3 and abs(held[0] - held[4]) < 0.1 and held[0] - held[1] < 0.25
    assert held[2] > 0.5 and held[3] > 0.5


def test_held_out_rows_teach_nothing(spark):
    rows = corpus(random.Random(7), 240)
    flipped = [(i, t, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, t, y in rows]
    a, b = (toxicity.train(*frames(spark, r)) for r in (rows, flipped))
    assert (a.buckets == b.buckets).all() and a.weights == pytest.approx(b.weights, abs=1e-6)
    few = toxicity.train(*frames(spark, rows), max_rows=60)
    assert len(few.buckets) and few.bias != a.bias


def test_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).withColumn("held", toxicity.is_held_out(F.col("doc_id"))).join(labels, "doc_id").where("held").collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in got)
    clean = sum(r.score >= 0.5 and r.toxic == 0 for r in got)
    assert len(got) > 800 and right / len(got) > 0.96 and clean <= 4


def test_odd_rows(spark):
    """Null, empty and very long texts, null and repeated ids, null and double labels, no labels, one label."""
    rows = [*corpus(random.Random(8), 120), (500, None, 1), (501, "", 0), (502, "vermin " * 40_000, 1), (503, "stone", None), (None, "vermin", 1), (7, "river", 1), (7, "river", 0)]
    docs, labels = frames(spark, rows)
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, *_ in rows)
    by = {r.doc_id: r.score for r in got}
    assert by[500] == by[501] == pytest.approx(1 / (1 + np.exp(-model.bias))) and by[502] > 0.5 and by[None] > 0.5
    assert all(0 <= r.score <= 1 for r in got)
    none = toxicity.train(docs, labels.where("false"))
    assert [r.score for r in toxicity.score(docs, none).collect()] == [pytest.approx(1 / 3)] * len(rows)
    clean = toxicity.train(docs, labels.where("toxic = 0"))
    assert max(r.score for r in toxicity.score(docs, clean).collect()) < 0.1
    assert toxicity.score(docs.where("false"), model).collect() == []
