"""Language ID: multinomial naive Bayes over hashed character n-grams.

Features are n-grams of 1 to 3 code points, hashed into ``buckets``; letters are
lower-cased and everything else counts as a space.  Counts of the training rows
are added up on the executors; the log-probability matrix (languages x buckets,
float32) is broadcast.  Its size is bounded by ``max_languages * buckets * 4``
bytes; more languages raise an error.  Scoring gathers the matrix rows of a
block's n-grams and adds them up by document in numpy, a slab of code points at
a time, so texts of any length are scored whole in bounded memory.

The classifier is fitted on at most about ``max_rows`` labelled rows, drawn by
a hash of their id (all of them, where there are fewer); null texts and null
languages are left out.  Prediction uses the text alone.  A text that is null
or has no letter is ``und`` with score 0.  Without any training row every text
is ``und``.  Repeated rows are predicted each for itself; ties go to the first
language in alphabetical order; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm import cluster, worker
from attestry.llm.text import Block, blocks

BUCKETS = 1 << 15
MAX_ROWS = 50_000
MAX_LANGUAGES = 256
_SLAB = 1 << 18
_CHUNK = 1024
_MULS = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def is_held_out(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 5 == 0


@lru_cache(1)
def _fold() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case letter or a space, and if it is a letter."""
    letter = np.zeros(0x110000, bool)
    fold = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isalpha():
            letter[c] = True
            low = ch.lower()
            fold[c] = ord(low) if len(low) == 1 else c
    return fold, letter


worker.caching(_fold.cache_clear)


def points(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points, row bounds, and which rows have a letter."""
    fold, letter = _fold()
    # A byte that does not continue a character starts one.
    heads = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    raw = np.frombuffer(block.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    bounds = heads[block.offsets]
    seen = np.concatenate([[0], np.cumsum(letter[raw])])[bounds]
    return fold[raw], bounds, seen[1:] > seen[:-1]


def ngrams(cp: np.ndarray, bounds: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram at each place, -1 where it runs over its row's end."""
    out = np.full(len(cp), -1, np.int32)
    if len(cp) < n:
        return out
    h = np.full(len(cp) - n + 1, n, np.uint64)
    for i in range(n):
        h += cp[i : len(cp) - n + 1 + i] * _MULS[i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    out[: len(h)] = h >> np.uint64(64 - (buckets.bit_length() - 1))
    if n > 1:
        ends = bounds[1:]
        for i in range(1, n):
            cut = ends - i
            out[cut[(cut >= 0) & (cut >= bounds[:-1])]] = -1
    return out


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities; the last column is the prior."""
    flat = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for block in blocks(batch, "text"):
                cp, bounds, _ = points(block)
                langs = block.rows.column("lang").to_pylist()
                names = sorted(set(langs))
                which = np.array([names.index(x) for x in langs])
                owner = np.repeat(which, np.diff(bounds))
                grid = np.zeros(len(names) * buckets, np.int64)
                for n in (1, 2, 3):
                    b = ngrams(cp, bounds, n, buckets)
                    ok = b >= 0
                    grid += np.bincount(owner[ok] * buckets + b[ok], minlength=len(grid))
                for i, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + grid[i * buckets : (i + 1) * buckets]
                    docs[name] = docs.get(name, 0) + int((which == i).sum())
                if len(sums) > MAX_LANGUAGES:
                    raise ValueError(f"over {MAX_LANGUAGES} languages")
        for name, grid in sums.items():
            chunks = grid.reshape(-1, _CHUNK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(chunks)), pa.array(range(len(chunks)), pa.int32()), pa.array([docs[name]] + [0] * (len(chunks) - 1), pa.int64()), pa.array([c.tobytes() for c in chunks], pa.binary())],
                ["lang", "chunk", "docs", "counts"],
            )

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK, np.int64)
        for c in table.column("counts"):
            total += np.frombuffer(c.as_buffer(), np.int64)
        return pa.table({"lang": [table.column("lang")[0].as_py()], "chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "docs": [sum(table.column("docs").to_pylist())], "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "lang string, chunk int, docs long, counts binary"
    parts = flat.mapInArrow(worker.tended("language", count), kind).groupBy("lang", "chunk").applyInArrow(add, kind).collect()  # languages x buckets / 1024 rows
    langs = sorted({r.lang for r in parts})
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    counts, prior = np.zeros((len(langs), buckets)), np.zeros(len(langs))
    for r in parts:
        counts[langs.index(r.lang), r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(r.counts, np.int64)
        prior[langs.index(r.lang)] += r.docs
    smooth = counts + 0.1
    table = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if langs else np.zeros((0, buckets))
    start = np.log((prior + 1) / (prior + 1).sum()) if langs else prior
    return langs, np.column_stack([table, start]).astype(np.float32)


def score(block: Block, table: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-posterior sums (rows x languages) and which rows have a letter."""
    cp, bounds, has = points(block)
    out = np.zeros((len(block), len(table))) + table[:, buckets]
    flat = np.ascontiguousarray(table[:, :buckets])
    row = np.repeat(np.arange(len(block)), np.diff(bounds))
    for n in (1, 2, 3):
        b = ngrams(cp, bounds, n, buckets)
        for lo in range(0, len(b), _SLAB):
            part, own = b[lo : lo + _SLAB], row[lo : lo + _SLAB]
            ok = part >= 0
            part, own = part[ok], own[ok]
            if not len(part):
                continue
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            for k in range(len(table)):
                out[own[heads], k] += np.add.reduceat(flat[k][part].astype(np.float64), heads)
    return out, has


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_column: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (posterior of that language), a
    struct ``carry`` of further columns if any are named, and with ``with_text``
    the ``text``, which crosses to the worker once."""
    spark = docs.sparkSession
    cluster.prepare(spark)
    langs, table = model
    buckets = table.shape[1] - 1
    sent = spark.sparkContext.broadcast((langs, table))
    extra = [F.struct(*[F.col(c) for c in carry]).alias("carry")] if carry else []
    flat = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), *extra)
    names = ["doc_id", "lang_pred", "score", *["carry"] * bool(carry), *["text"] * with_text]
    kinds = f"doc_id {flat.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double" + (f", carry {flat.schema['carry'].dataType.simpleString()}" if carry else "") + ", text string" * with_text

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = sent.value
        for batch in batches:
            for block in blocks(batch, "text"):
                sums, has = score(block, table, buckets)
                if langs:
                    best = sums.argmax(axis=1)
                    sure = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                    said = [langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
                    sure = np.where(has, sure, 0.0)
                else:
                    said, sure = ["und"] * len(block), np.zeros(len(block))
                yield pa.RecordBatch.from_arrays([block.rows.column("doc_id"), pa.array(said, pa.string()), pa.array(sure), *([block.rows.column("carry")] if carry else []), *([block.rows.column("text")] if with_text else [])], names)

    return flat.mapInArrow(worker.tended("language", rows), kinds)


def train(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Fit on the rows that aren't held out, about ``max_rows`` at most."""
    cluster.prepare(docs.sparkSession)
    known = docs.where(~F.coalesce(is_held_out(F.col(id_column)), F.lit(False)) & F.col(lang).isNotNull())
    n = known.select(id_column).count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64(id_column), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    return fit(known, text, lang, buckets)
