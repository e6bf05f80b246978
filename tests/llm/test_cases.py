"""Defined results of odd cases, and brute-force versions of what SQL can't say."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import ALNUM, LOWER, jaccard_groups
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestry.llm import chat_format, cluster, embedding_dedup, jaccard_join, language_id, license_scan, packing, substring_dedup, token_counts, wavelet
from attestry.llm.tokens import path


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, leader string, n int").repartition(parts)


def test_language_by_brute_force(spark):
    """Posteriors from counts of n-grams in dictionaries, hashed one at a time."""
    rng = random.Random(2)
    alphabets = {"aa": "abcd ", "bb": "bcde-", "cc": "éüñabZ7 "}
    text = lambda lang, n: "".join(rng.choice(alphabets[lang]) for _ in range(n))
    train = [(text(lang, rng.randrange(5, 60)), lang) for lang in alphabets for _ in range(9)]
    buckets, muls = 1 << 10, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

    def grams(t):
        cp = [ord(c.lower()) if c.isalpha() else 0x20 for c in t]
        for n in (1, 2, 3):
            for i in range(len(cp) - n + 1):
                h = (n + sum(c * m for c, m in zip(cp[i : i + n], muls))) % 2**64
                h ^= h >> 29
                yield h * 0xBF58476D1CE4E5B9 % 2**64 >> 54

    counts, prior = defaultdict(Counter), Counter(lang for _, lang in train)
    for t, lang in train:
        counts[lang].update(grams(t))
    model = language_id.fit(spark.createDataFrame(train, "text string, lang string").repartition(3), buckets=buckets)
    rows = [(i, text(rng.choice(list(alphabets)), rng.randrange(1, 80))) for i in range(80)] + [(90, None), (91, ""), (92, "77 -"), (93, "abz" * 9000), (1, "abcd")]
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.predict(docs(spark, rows), model).collect())
    want = []
    for i, t in rows:
        if not any(c.isalpha() for c in t or ""):
            want.append((i, "und", 0.0))
            continue
        logs = {}
        for lang in alphabets:
            total = sum(counts[lang].values()) + 0.1 * buckets
            logs[lang] = math.log((prior[lang] + 1) / (len(train) + 3)) + sum(math.log((counts[lang][g] + 0.1) / total) for g in grams(t))
        best = max(logs, key=logs.get)
        want.append((i, best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=2e-3), (g, w)


def license_brute(text):
    words = ALNUM.findall((text or "").translate(LOWER))
    best = {}
    for number, (template, label) in enumerate(license_scan.TEXTS):
        t = template.split()
        grams = {}
        for i in range(len(t) - 2):
            grams.setdefault(tuple(t[i : i + 3]), []).append(i)
        half = max(8, (len(t) - 2) // 4)
        spots = [(p, at) for p in range(len(words) - 2) for at in grams.get(tuple(words[p : p + 3]), [])]
        for band in {(p - at) // half + d for p, at in spots for d in (-1, 0)}:
            own = [s for s in spots if (s[0] - s[1]) // half in (band, band + 1)]
            if len({at for _, at in own}) < license_scan.SHARE * (len(t) - 2):
                continue
            longest = {}
            for p, at in own:  # in order of place
                longest[(p, at)] = 1 + max((n for (q, b), n in longest.items() if q < p and b < at), default=0)
            share = max(longest.values()) / (len(t) - 2)
            if share >= license_scan.SHARE:
                best[number] = max(best.get(number, 0), share)
    return {license_scan.TEXTS[n][1] for n in best}, max(best.values(), default=0.0)


def test_licenses_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(1, "in all copies " * 14), (2, "the public domain " * 6), (3, None), (4, ""), (5, "in all copies of the software " * 300)]
    for i, (template, _) in enumerate(license_scan.TEXTS):
        for kind in range(5):
            w = template.split()
            if kind == 1:  # a few words in and out
                for _ in range(len(w) // 20 + 1):
                    w.insert(rng.randrange(len(w)), "extra")
                    del w[rng.randrange(len(w))]
            if kind == 2:
                rng.shuffle(w)
            if kind == 3:  # halves the other way round
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            if kind == 4:
                w = w[: len(w) // 2]
            rows.append((10 + i * 5 + kind, " ".join(["before"] * rng.randrange(9) + w + ["after"])))
    rows.append((900, " ".join(t for t, _ in license_scan.TEXTS)))
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        labels, score = license_brute(t)
        extra = {"gpl"} if "general public license" in (t or "") else set()
        assert set(filter(None, got[i].labels.split(","))) == labels | extra, (i, got[i].labels, labels)
        assert got[i].score == pytest.approx(max(score, float(bool(extra)))), i
    assert got[1].labels == got[2].labels == "" and "mit" in got[10].labels


def test_blocks_are_skipped(spark):
    """Of one list, sets of far sizes and places lie in blocks that nothing meets."""
    rows = [(1, 100, 0, 0, 110), (2, 100, 0, 0, 110), (3, 300, 0, 8, 330), (4, 100, 0, 3, 90), (5, 40, 0, 1, 44)]
    entries = spark.createDataFrame([(7, *r) for r in rows] + [(8, 6, 50, 0, 4, 50)], "shingle long, id long, n long, own long, blk long, reach long")
    left = {(r.shingle, r.blk, r.leader) for r in jaccard_join.lists(entries, 90).collect()}
    # Of five blocks and a list of one, only the two equal sets' block is left.
    assert left == {(7, 0, 1)}


def test_answers_are_derived():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(1, 1 << 60, 200, dtype=np.uint64))
    leader = base[:150]
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(100, 180)], rng.integers(1, 1 << 60, rng.integers(0, 9), dtype=np.uint64)])) for _ in range(40)]
    d = [np.setxor1d(s, leader) for s in sets]
    common = np.array([len(np.intersect1d(s, leader)) for s in sets])
    n = np.array([len(s) for s in sets])
    for percent in (50, 70, 90):
        got = jaccard_join.derived(common, common, len(leader), d, d, n, n, percent)
        want = [[100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) for b in sets] for a in sets]
        assert got.tolist() == want


def test_forest():
    rng = np.random.default_rng(1)
    for _ in range(30):
        hit = rng.random((9, 12)) < rng.choice([0, 0.1, 0.5])
        x, y = np.arange(9), np.arange(100, 112)
        a, b = cluster.forest(x, y, hit)
        groups = lambda edges: {frozenset(v for v in reach(s, edges)) for s, _ in edges}

        def reach(s, edges):
            seen, todo = {s}, [s]
            while todo:
                u = todo.pop()
                for p, q in edges:
                    for v in (q,) if p == u else (p,) if q == u else ():
                        if v not in seen:
                            seen.add(v)
                            todo.append(v)
            return seen

        full = [(int(x[i]), int(y[j])) for i, j in zip(*np.nonzero(hit))]
        tree = list(zip(a.tolist(), b.tolist()))
        assert set(tree) <= set(full) and groups(tree) == groups(full)
        assert len(tree) == sum(len(g) - 1 for g in groups(full))


def test_join_odd_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a), (2, a), (2, a), (3, a), (3, b), (4, b), (None, a), (None, a), (5, None), (5, ""), (6, "x" * 400_000), (7, "x" * 400_000)]
    got = sorted(map(tuple, jaccard_join.join_groups(docs(spark, rows), k=3, percent=90).collect()), key=str)
    # 3 counts with its longer text; rows without an id link with nothing.
    want = jaccard_groups([(1, a), (2, a), (3, a), (4, b), (5, None), (6, rows[-1][1]), (7, rows[-1][1])], 3, 90) + [(None, 58, None)] * 2
    assert got == sorted(want, key=str)


def test_vectors_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (4, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (None, None, None)]
    got = sorted(map(tuple, embedding_dedup.link_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()), key=str)
    want = [(1, 1, 1, True), (2, 1, 1, True), (3, 1, 3, True), (4, 1, 3, False), (None, 0, None, None), (None, 0, None, None)]
    assert got == sorted([w if w[0] != 2 else (2, 1, 1, False) for w in want], key=str)


def test_files_keep_null_ids(spark, tmp_path):
    rows = [(None, "none"), (-1, "minus one"), (None, None), (0, "zero"), (7, "b"), (7, "a"), (7, None)]
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    wavelet.write(docs(spark, rows), str(tmp_path / "w"))
    got = sorted(map(tuple, wavelet.read(spark, str(tmp_path / "w")).collect()), key=lambda r: r[1])
    order = [(None, None), (None, "none"), (-1, "minus one"), (0, "zero"), (7, None), (7, "a"), (7, "b")]
    at = 0
    for (i, t), g in zip(order, got, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert g == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_open_windows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_OPEN", 5)
    rows = [(i, "word " * (2100 + i % 7)) for i in range(40)] + [(None, "a b"), (None, None), (3, "word")]
    pieces = packing.pack(docs(spark, rows, 2)).collect()
    filled = Counter()
    for p in pieces:
        filled[p.sequence_id] += p.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in filled.values())
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    total = Counter()
    for i, t in rows:
        total[i] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == total
    packer, most = packing.Packer(10), 0
    for i in range(100):
        if packer.place((i, 0, np.zeros(6, np.uint32), 6)) is None and packer.levels.sum() >= 5:
            assert all(sum(len(x[2]) for x in w) == 10 for w in packer.rest(last=False))
        most = max(most, int(packer.levels.sum()))
        assert [len(w) for w in packer.open] == packer.levels.tolist()
    assert most <= 5


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "the cat"), (1, "the cat"), (None, "the cat"), (None, None), (2, "")]
    n = len(Tokenizer.from_file(path("byte_bpe_50k.json")).encode("the cat").ids)
    counted = sorted((tuple(r) for r in token_counts.count_tokens(docs(spark, rows)).collect()), key=str)
    assert counted == sorted([(1, 7, n, False)] * 2 + [(None, 7, n, False), (None, 0, 0, False), (2, 0, 0, False)], key=str)
    said = language_id.predict(docs(spark, rows), (["en"], np.zeros((1, 17), np.float32))).collect()
    assert sorted(((r.doc_id, r.lang_pred) for r in said), key=str) == sorted([(1, "en")] * 2 + [(None, "en"), (None, "und"), (2, "und")], key=str)
    long = " ".join(map(str, range(40)))
    cut = substring_dedup.remove_repeats(docs(spark, [(None, long), (1, long), (None, None)])).collect()
    assert sorted(((r.carry.doc_id, r.n_removed) for r in cut), key=str) == [(1, 40), (None, 0), (None, 40)]


def test_hash_table_of_lengths():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 2**64, 3000, dtype=np.uint64))
    lengths = np.arange(len(keys)) % 60000
    table = token_counts.hash_table(keys, lengths, 3000)
    got = token_counts.looked_up(table, keys)
    assert ((got == lengths) | (got == -1)).all() and (got >= 0).mean() > 0.9
    assert (token_counts.looked_up(table, rng.integers(1, 2**64, 500, dtype=np.uint64)) == -1).all()
    assert (token_counts.looked_up(token_counts.hash_table(keys[:0], lengths[:0], 8), keys) == -1).all()


def test_replies_below_a_cycle(spark):
    trees = [(1, 1, 2, "u", "a", 0.0), (1, 2, 1, "u", "b", 0.0), (1, 3, 1, "u", "hangs", 0.0), (2, 1, None, "u", "root", 0.0), (2, 2, 1, "assistant", "é" * 300_000, 0.0), (3, 1, 1, "u", "own parent", 0.0), (3, 2, 1, "u", "below", 0.0)]
    trees += [(4, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(200)] + [(4, 1000, 1000, "u", "loop", 0.0), (4, 1001, 1000, "u", "below", 0.0)]
    df = spark.createDataFrame(trees, "tree long, msg long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): len(r.turns) for r in chat_format.ranked(df).collect()}
    assert got == {(2, 2): 2, (4, 199): 200}
    out = chat_format.formatted(chat_format.ranked(df.where("tree = 2"))).select(chat_format.loss_text(F.col("formatted"), F.col("loss")).alias("l")).first()
    assert out.l == "é" * 300_000


def test_folder_must_be_shared(spark, monkeypatch):
    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), spark.conf

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        cluster.prepare(Session())
