import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from attestry.llm import packing, token_counts, tokens, wavelet
from attestry.llm.text import Block
from attestry.llm.tokens import Encoder, path

ODD = [
    None,
    "",
    " ",
    "  \n\n x  y\t z \n",
    "it's we're I'll 's 'St ''s a's's don't 'd 're'ver 'l 'll'",
    "<|endoftext|> a <|startoftext|>b <|endoftext|",
    "1234 5a6 ½ ²x €5 “quoted” – dash …",
    "ÉCOLE Ünï İstanbul ΣΑΣ ǅ ſ",
    "日本語 текст עברית é  nbsp \x85 \x1c",
    "a\r\nb\x0bc\x0cd !! ?!' '' ' s",
    "x" * 70_000,
    "word " * 9000,
]


def texts(n=300, seed=5):
    rng = random.Random(seed)
    alphabet = ["a", "B", "the", "é", " ", " ", "  ", "\n", "'", "'s", "'re", "1", "23", ".", ",", "!", "ß", "Ä", "_", "<", "\t"]
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def block(rows):
    return Block(pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["text"]), "text")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    rows = texts()
    library = Tokenizer.from_file(path(name))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in rows]
    enc = Encoder(path(name))
    assert enc.known
    got = enc.block(block(rows))
    for i, w in enumerate(want):
        assert got.values[got.bounds[i] : got.bounds[i + 1]].tolist() == w, rows[i]
    assert enc.block(block(rows), lengths=True).values.tolist() == [len(w) for w in want]


class Counted:
    """A model that counts what it is asked for."""

    def __init__(self, model):
        self.model, self.asked = model, 0

    def tokenize(self, piece):
        self.asked += 1
        return self.model.tokenize(piece)


def test_pieces_of_large_blocks_are_encoded_once():
    enc = Encoder(path("byte_bpe_50k.json"))
    enc.model = Counted(enc.model)
    name = "".join(chr(97 + i) for i in range(26))
    words = [f"{a}{b}{c}{d}" for a in name for b in name for c in name for d in name[:13]]
    one, two = block([" ".join(words[:110_000])]), block([" ".join(words[110_000:220_000])])
    first = enc.block(one)
    enc.block(two)
    again = enc.block(one)
    assert enc.model.asked == 220_000
    assert again.values.tolist() == first.values.tolist()


@pytest.mark.parametrize("limits", [(1, 10**6), (60, 10**6), (10**6, 200), (10**6, 0)])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_full_cache_keeps_its_bounds(name, limits, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_SIZE", limits[0])
    monkeypatch.setattr(tokens, "CACHE_IDS", limits[1])
    library, enc = Tokenizer.from_file(path(name)), Encoder(path(name))
    rows = texts(200)
    for k in [0, 40, 80, 0, 120, 80, 160, 0]:
        part = rows[k : k + 40]
        got = enc.block(block(part))
        want = [library.encode(t or "", add_special_tokens=False).ids for t in part]
        assert [got.values[a:b].tolist() for a, b in zip(got.bounds[:-1], got.bounds[1:], strict=True)] == want
        assert enc.block(block(part), lengths=True).values.tolist() == [len(w) for w in want]
        full = len(enc.cache) > limits[0] or len(enc.cache.flat) > limits[1]
        enc.cache.next_block()
        assert not full or len(enc.cache) <= limits[0] // 2 and enc.cache.size.max(initial=0) <= tokens.LONG


def test_hashes_do_not_depend_on_chunks(monkeypatch):
    enc = Encoder(path("byte_bpe_50k.json"))
    joined, start, end, _ = enc.split([t or "" for t in texts()])
    whole = enc.hash_pieces(joined, start, end)
    monkeypatch.setattr(tokens, "CHUNK", 5)
    assert (enc.hash_pieces(joined, start, end) == whole).all()
    assert len(set(whole.tolist())) == len({joined[a:b] for a, b in zip(start, end, strict=True)})


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, n_tokens int").repartition(3)


def test_counts(spark):
    rows = texts()
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = []
    for i, t in enumerate(rows):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    for size in (4, 1 << 15):
        assert sorted(map(tuple, token_counts.count_tokens(docs(spark, rows), table=size).collect())) == want
    assert token_counts.count_tokens(docs(spark, [])).count() == 0


def test_summaries_keep_frequent_ones():
    found = {}
    for part in ({"a": 5, "b": 1, "c": 1}, {"a": 4, "d": 2}, {"e": 1, "a": 3}):
        found = token_counts.add(found, part, 2)
    assert len(found) <= 2 and found["a"] >= 12 - 10 // 3 - 3


def test_wavelet_answers():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (513, 3), (3000, 70_000)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        m = wavelet.WaveletMatrix.frombytes(wavelet.WaveletMatrix.build(ids, np.array([7]), np.array([n])).tobytes())
        assert m.decode().tolist() == ids.tolist()
        assert m.access(np.arange(n)).tolist() == ids.tolist()
        for t in set(ids[:5].tolist()) | {0, top + 9}:
            where = np.flatnonzero(ids == t).tolist()
            assert m.count(t) == len(where) and m.find(t) == where
            assert m.count(t, n // 3, n // 2) == sum(n // 3 <= w < n // 2 for w in where)


def test_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_IDS", 3000)
    rows = texts(80)
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    wavelet.write(docs(spark, rows), str(tmp_path / "w"))
    got = sorted(map(tuple, wavelet.read(spark, str(tmp_path / "w"), with_ids=True).collect()))
    at = 0
    for i, t in enumerate(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert got[i] == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)
    wavelet.write(docs(spark, []), str(tmp_path / "e"))
    assert wavelet.read(spark, str(tmp_path / "e")).count() == 0


def test_packing_covers_every_id_once(spark):
    rows = texts() + ["word " * 3000] * 3
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    pieces = packing.pack(docs(spark, rows)).collect()
    for i, t in enumerate(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted((p.start, p.ids) for p in pieces if p.doc_id == i)
        assert b"".join(x for _, x in own) == np.array(ids, "<u4").tobytes()
        assert {p.doc_tokens for p in pieces if p.doc_id == i} == {len(ids)}
    pads = 0
    for s in {p.sequence_id for p in pieces}:
        own = sorted((p.offset, p.length) for p in pieces if p.sequence_id == s)
        total = 0
        for at, n in own:
            assert at == total and n > 0
            total += n
        assert total <= 4096
        pads += 0 if total & (total - 1) == 0 else 4096 - total
    assert pads == 0
    assert packing.pack(docs(spark, [])).count() == 0


def test_levels_follow_the_sum_of_squares():
    rng = random.Random(3)
    p = packing.Packer(20)
    for i in range(400):
        size = rng.randrange(1, 20)
        before = p.levels.copy()

        def cost(h):
            n = before.copy()
            if h:
                n[h] -= 1
            if h + size < 20:
                n[h + size] += 1
            return int((n * n).sum())

        options = [0, *[h for h in range(1, 21 - size) if before[h]]]
        p.place((i, 0, np.zeros(size, np.uint32), size))
        assert int((p.levels * p.levels).sum()) == min(map(cost, options))
        assert [len(w) for w in p.open] == p.levels.tolist()
