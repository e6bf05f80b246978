import random

import pytest
from brute import jaccard_groups, repeats, sha
from pyspark.sql import functions as F

from attestry.llm import jaccard_join
from attestry.llm.jaccard_join import join_groups
from attestry.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id long, text string, carry string, n_words int"


def corpus(seed=3, n=140):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ä", "Bee", "c", "dä", "e,"]) + str(rng.randrange(30))
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(150)]
    docs = []
    for i in range(n):
        w = [word() for _ in range(rng.choice([0, 1, 2, 3, 34, 35, 36, 90, 200]))]
        kind = i % 5
        if kind == 1:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        if kind == 2:
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = word()
        if kind == 3 and docs and docs[-1][1]:
            w = docs[rng.randrange(len(docs))][1]
            w = (w or "").split(" ")
        docs.append((i, rng.choice([" ", " ", "\n"]).join(w)))
    docs += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "same " * 500), (n + 4, "same " * 400), (n + 5, "x" * 300_000), (n + 6, " a b"), (n + 7, "One two"), (n + 8, "one  TWO")]
    return docs


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(i, t, "c", 0) for i, t in docs], SCHEMA).repartition(parts, "doc_id")


@pytest.mark.parametrize("window", [35, 3])
def test_repeats(spark, window):
    docs = corpus()
    out = remove_repeats(frame(spark, docs), window=window)
    rows = out.select("carry.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256), "removed").collect()
    assert sorted(tuple(r)[:4] for r in rows) == repeats(docs, window)
    assert all(sum(s["to"] - s["from"] for s in r.removed) == r.n_removed for r in rows)
    assert any(r.n_removed for r in rows)


def test_repeated_rows_and_empty_tables(spark):
    docs = [(1, " ".join(map(str, range(40)))), (1, " ".join(map(str, range(40))))]
    rows = remove_repeats(frame(spark, docs), carry=("doc_id", "carry")).collect()
    assert [(r.carry.doc_id, r.carry.carry, r.n_removed, r.kept_text) for r in rows] == [(1, "c", 40, "")] * 2
    assert remove_repeats(frame(spark, [])).count() == 0
    assert join_groups(frame(spark, [])).count() == 0
    assert sha("") in [r[3] for r in repeats([(1, None)], 35)]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 50)])
def test_groups(spark, k, percent):
    docs = corpus()
    got = sorted(map(tuple, join_groups(frame(spark, docs), k=k, percent=percent).collect()))
    assert got == jaccard_groups(docs, k, percent)
    assert len({c for _, _, c in got}) < len(got)


def test_many_near_copies(spark, monkeypatch):
    from attestry.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "TILE", 16)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(120)] = f"n{rng.randrange(90)}"
        docs.append((i, " ".join(w)))
    got = sorted(map(tuple, join_groups(frame(spark, docs), k=3, percent=90).collect()))
    assert got == jaccard_groups(docs, 3, 90)


def test_large_leader_comes_out_in_small_batches(spark, monkeypatch):
    """Differences from a leader of many shingles are sent as soon as they fill a batch."""
    rng = random.Random(9)
    passage = [f"w{i}" for i in range(3000)]
    docs = [(0, " ".join(passage))] + [(i, " ".join(passage[a : a + 40] + [f"x{i}y{j}" for j in range(rng.randrange(3))])) for i in range(1, 60) for a in [rng.randrange(0, 2900, 7)]]
    monkeypatch.setattr(jaccard_join, "OUT", 50_000)
    got = sorted(map(tuple, jaccard_join.join_groups(spark.createDataFrame(docs, "doc_id long, text string"), k=3, percent=90).collect()))
    assert got == jaccard_groups(docs, 3, 90)
