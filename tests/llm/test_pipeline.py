import pytest
from brute import ALNUM, LOWER, hits, jaccard_groups
from tokenizers import Tokenizer

import corpus_pipeline
from attestry.llm.tokens import path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The input and each stage's output, as run() has them."""
    folder = tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return [[r.asDict() for r in d.collect()] for d in out]


def test_language_keeps_prose(steps):
    kept = {r["doc_id"] for r in steps[1]}
    assert all(r in steps[0] for r in steps[1])
    assert all(r["doc_id"] in kept for r in steps[0] if len(ALNUM.findall((r["text"] or "").translate(LOWER))) > 30)


def test_one_of_each_group_stays(steps):
    groups = jaccard_groups([(r["doc_id"], r["text"]) for r in steps[1]], 5, 80)
    assert sorted(r["doc_id"] for r in steps[2]) == [i for i, _, c in groups if i == c]
    assert all(r in steps[1] for r in steps[2])


def test_repeats_go(steps):
    from collections import Counter

    from brute import SPACED

    words = {r["doc_id"]: SPACED.findall(r["text"]) for r in steps[2]}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    want = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        if not all(gone):
            want[d] = [x for x, g in zip(w, gone) if not g]
    assert {r["doc_id"]: SPACED.findall(r["text"]) for r in steps[3]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in steps[3])


def test_contaminated_go(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = hits([(r["doc_id"], r["text"]) for r in steps[3]], items)
    assert sorted(r["doc_id"] for r in steps[4]) == [i for i, _, n, _ in found if not n]
    assert len(steps[4]) < len(steps[3])


def test_packed(steps):
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    total = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in steps[4]}
    got = {}
    for r in steps[5]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == total


def test_odd_rows(spark, tmp_path):
    """Each stage on nulls, empty, very long and repeated texts, and on no rows."""
    long = " ".join(f"the word{i} and of that" for i in range(30_000))
    same = "the and of the with that is a text of some more words than five"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5), (4, same, None, None, None), (4, same, None, None, None), (5, same, "en", "s", 9), (None, same, "en", "s", 9), (6, long, "en", "s", 1), (7, "the item of ten words is here in the text too", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (2, ""), (3, "the item of ten words is here in the text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id if r.doc_id is not None else 0) for r in df.collect())
    of = lambda name: stage[name](spark, docs, str(tmp_path))
    assert ids(of("language_id")) == [0, 4, 4, 5, 6, 7]  # no letter, no language
    assert ids(of("ngram_jaccard_join")) == [0, 1, 2, 3, 4, 4, 6, 7]  # 5 is a copy of 4; no id, no link
    assert ids(of("substring_dedup")) == [0, 1, 2, 3, 4, 4, 5, 6, 7]  # nothing repeats over 35 words
    assert ids(of("benchmark_decontamination")) == [0, 1, 2, 3, 4, 4, 5, 6]
    packed = {}
    for r in of("packing").collect():
        packed.setdefault(r.doc_id, set()).add(r.doc_tokens)
    assert set(packed) == {1, 2, 3, 4, 5, 6, 7, None} and packed[1] == packed[2] == {1} and min(packed[6]) > 4096
    for f in stage.values():
        assert f(spark, docs.limit(0), str(tmp_path)).count() == 0
