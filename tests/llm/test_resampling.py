"""Importance resampling against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
from brute import ALNUM, LOWER
from pyspark.sql import functions as F

from attestry.llm import resampling

SCHEMA = "doc_id long, text string, score int, rank string, n_words int, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 3, 4) for i, t in rows], SCHEMA).repartition(3)


def found(text, longest, size):
    w = ALNUM.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % size for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent, least, seed, longest=2, size=10_000):
    s = Counter(b for _, t in docs for b in found(t, longest, size)[1])
    t = Counter(b for _, x in target for b in found(x, longest, size)[1])
    big, goal = sum(s.values()) + size, sum(t.values()) + size
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * big / ((s[b] + 1) * goal)))
    out = []
    for i, text in docs:
        n, own = found(text, longest, size)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    ranked = [(*r, k + 1 if k < percent * len(may) // 100 else None) for k, r in enumerate(may)]
    return sorted([*ranked, *[(*r, None) for r in out if r[1] < least]], key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)


def texts(rng, n, longest):
    vocab = ["Alpha", "beta", "GAMMA9", "ß", "İx", "日本", "7", "d_e", "é f", "\x7f"]
    return [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(rng.randrange(longest)))) for i in range(n)]


def test_random_texts(spark):
    rng = random.Random(3)
    docs = [*texts(rng, 60, 40), (60, None), (61, ""), (62, "... !"), (63, "one"), (None, "a b c " * 9), (None, "a b c " * 9), (5, "word " * 30), (5, "word " * 30), (5, "other " * 31), (64, "alpha beta " * 60_000)]
    target = [*texts(rng, 5, 20), (1, None)]
    for percent, least, longest in ((25, 20, 2), (100, 0, 2), (40, 3, 3), (0, 0, 1)):
        want = brute(docs, target, percent, least, 7, longest)
        gain = resampling.gains(resampling.totals(frame(spark, docs), longest=longest), resampling.totals(frame(spark, target), longest=longest))
        scored = resampling.weighted(frame(spark, docs), gain, longest=longest).withColumn("score", F.col("weight") + resampling.gumbel(F.col("doc_id"), 7))
        assert rows(resampling.drawn(scored, percent, F.col("n_words") >= least)) == want
        if longest == 2:
            assert rows(resampling.resample(frame(spark, docs), frame(spark, target), percent, least)) == want


def test_empty_tables(spark):
    """Without documents no row; without a target the gains come from the corpus alone."""
    docs = texts(random.Random(1), 12, 30)
    assert rows(resampling.resample(frame(spark, []), frame(spark, docs))) == []
    assert rows(resampling.resample(frame(spark, docs), frame(spark, []))) == brute(docs, [], 25, 20, 7)
    assert set(resampling.gains(np.zeros(4, np.int64), np.zeros(4, np.int64))) == {0}


def test_many_equal_scores(spark):
    """Copies of one row all have one score; ranks go on over the cut."""
    docs = [(9, "same words here " * 8)] * 50 + [(i, f"w{i} " * 21) for i in range(10, 40)]
    assert rows(resampling.resample(frame(spark, docs), frame(spark, [(1, "same words")]))) == brute(docs, [(1, "same words")], 25, 20, 7)


def test_no_python_and_one_split(spark):
    """Scoring is one JVM projection that finds the words once, and nothing is exploded."""
    plan = resampling.weighted(frame(spark, [(1, "a")]), [0] * 100)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Python" not in plan.replace("ExistingRDD", "") and plan.count("split(") == 1
