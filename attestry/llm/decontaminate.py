"""Benchmark decontamination by winnowing.

A *window* is ``window`` consecutive words of a benchmark item.  Both sides
keep, of every ``window - gram + 1`` consecutive k-grams, the one of least
hash; any shared window then has a fingerprint in common (winnowing guarantee).
Training and test fingerprints are joined in Spark.  A hit is extended word by
word to both sides, over the words that the fingerprint carries (``window -
gram`` on each side); if the shared span has ``window`` words, all of them are
hit.  Every shared window has a shared fingerprint within it, so together the
extended hits are all of them.

An item of fewer words than a window is one window of its own length.  It has
one fingerprint, the least hash of its words; documents give each word whose
hash is such a fingerprint, with as many words around it.

Documents give only fingerprints that pass a bitmap of the test fingerprints
(2**22 bits, broadcast; a full bitmap would only cost time).  No text is moved.

A null or empty text has no word and no hit; a null or empty item has no
window.  Equal items are all reported.  Repeated rows are judged each for
itself; empty tables on either side give no hit; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import cluster, worker
from attestry.llm.text import ALNUM, Words, blocks, mix, rolling

WINDOW, GRAM = 10, 5
BITS = 1 << 22


def winnow(values: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Places of the least value (the last of equals) of any ``size``
    consecutive values of a row."""
    n = len(values)
    if n < size:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(values, size)
    start = np.flatnonzero(np.arange(n - size + 1) + size <= np.repeat(bounds[1:], np.diff(bounds))[: n - size + 1])
    best = np.empty(len(start), np.int64)
    for lo in range(0, len(start), 1 << 16):
        part = start[lo : lo + (1 << 16)]
        best[lo : lo + len(part)] = part + size - 1 - np.argmin(least[part][:, ::-1], axis=1)
    return np.unique(best)


def _bit(finger: np.ndarray) -> np.ndarray:
    return (mix(finger, 5) >> np.uint64(42)).astype(np.int64)


def _fingers(words: Words, hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Word places of the winnowed k-grams."""
    grams = rolling(hashes, gram)
    if not len(grams):
        return np.zeros(0, np.int64)
    # k-grams that run over a row's end are left out by bounds.
    ok = np.arange(len(grams)) + gram <= words.stop()[: len(grams)]
    row = np.repeat(np.arange(len(words.counts)), words.counts)[: len(grams)][ok]
    place = np.flatnonzero(ok)
    return place[winnow(grams[place], np.searchsorted(row, np.arange(len(words.counts) + 1)), window - gram + 1)]


def _context(hashes: np.ndarray, words: Words, place: np.ndarray, row: np.ndarray, left: int, right: int) -> pa.Array:
    """Hashes of the words from ``left`` before to ``right`` after; 0 beyond the row."""
    at = place[:, None] + np.arange(-left, right + 1)
    ok = (at >= words.first[row][:, None]) & (at < words.first[row + 1][:, None])
    out = np.where(ok, hashes[np.clip(at, 0, max(len(hashes) - 1, 0))] | np.uint64(1), np.uint64(0))
    ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel().view(np.int64)))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    for block in blocks(batch, "text"):
        words = Words(block, ALNUM, lower=True)
        yield block, words, words.hashes()


def find(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: ``doc_id``, ``n_words``, ``n_hit``, ``items``
    (sorted ids as strings), ``spans`` (merged word intervals that are hit) and
    ``carry``, a struct of further columns, if any are named."""
    spark = docs.sparkSession
    cluster.prepare(spark)
    reach = window - gram
    extra = [F.struct(*[F.col(c) for c in carry]).alias("carry")] if carry else []
    # Rows are named by partition and place below, so a partition made anew must hold the same rows.
    flat = cluster.settled(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), *extra))
    doc_kind = flat.schema["doc_id"].dataType.simpleString()
    tests = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text"))

    def test_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, hashes in _rows(batch):
                place = _fingers(words, hashes, window, gram)
                row = np.searchsorted(words.first, place, "right") - 1
                key = rolling(hashes, gram)[place] if len(place) else np.zeros(0, np.uint64)
                around = _context(hashes, words, place, row, reach, gram - 1 + reach)
                need, pivot = np.full(len(place), window), np.full(len(place), reach)
                ids = block.rows.column("item_id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids, around, pa.array(need), pa.array(pivot)], ["finger", "item_id", "words", "size", "pivot"])
                short = np.flatnonzero((words.counts > 0) & (words.counts < window))
                first = np.array([int(words.first[i]) + int(np.argmin(hashes[words.first[i] : words.first[i + 1]])) for i in short], np.int64)
                own = [(hashes[words.first[i] : words.first[i + 1]] | np.uint64(1)).view(np.int64) for i in short]
                key = mix(hashes[first], 99) if len(first) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), block.rows.column("item_id").take(pa.array(short)), pa.array(own, pa.list_(pa.int64())), pa.array(words.counts[short]), pa.array(first - words.first[short])], ["finger", "item_id", "words", "size", "pivot"]
                )

    tested = cluster.written(tests.mapInArrow(worker.tended("benchmark", test_rows), "finger long, item_id string, words array<bigint>, size long, pivot long"), "fingers")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(_bit(batch.column("finger").to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    bitmap = np.zeros(BITS // 64, np.int64)
    for r in tested.mapInArrow(worker.tended("benchmark", bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():  # 65536 rows at most
        bitmap[r.word] = r.bits
    sent = spark.sparkContext.broadcast(bitmap.view(np.uint64))

    def passes(finger: np.ndarray) -> np.ndarray:
        bit = _bit(finger)
        return (sent.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1

    names = ["uid", "doc_id", "n_words", "hits", *["carry"] * bool(carry)]

    def doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for block, words, hashes in _rows(batch):
                place = _fingers(words, hashes, window, gram)
                key = rolling(hashes, gram)[place] if len(place) else np.zeros(0, np.uint64)
                ok = passes(key)
                place, key = place[ok], key[ok]
                single = mix(hashes, 99)
                lone = np.flatnonzero(passes(single))
                at, finger = np.concatenate([place, lone]), np.concatenate([key, single[lone]])
                wide = np.concatenate([np.ones(len(place), bool), np.zeros(len(lone), bool)])
                order = np.argsort(at, kind="stable")
                at, finger, wide = at[order], finger[order], wide[order]
                row = np.searchsorted(words.first, at, "right") - 1
                # Enough for a k-gram in a window and for a word in a short item.
                around = _context(hashes, words, at, row, window - 1, window - 1)
                bounds = np.searchsorted(at, words.first)
                spot = at - words.first[row]
                hits = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([pa.array(finger.view(np.int64)), pa.array(spot), around], ["finger", "place", "around"]))
                yield pa.RecordBatch.from_arrays([pa.array(uid + np.arange(len(block))), block.rows.column("doc_id"), pa.array(words.counts), hits, *([block.rows.column("carry")] if carry else [])], names)
                uid += len(block)

    kinds = f"uid long, doc_id {doc_kind}, n_words long, hits array<struct<finger:bigint,place:bigint,around:array<bigint>>>" + (f", carry {flat.schema['carry'].dataType.simpleString()}" if carry else "")
    rows = flat.mapInArrow(worker.tended("benchmark", doc_rows), kinds)
    keep = ["uid", "doc_id", "n_words", *["carry"] * bool(carry)]
    rows = rows.select(*keep, F.explode_outer("hits").alias("hit")).select(*keep, "hit.finger", "hit.place", "hit.around")
    # A document without candidates joins under a key of its own, not all under one.
    rows = rows.withColumn("finger", F.coalesce("finger", F.xxhash64("uid")))
    joined = rows.join(tested, "finger", "left")
    # The words around a candidate against those of the item, as far as the
    # fingerprint carries them; then the run of equal ones through the hit itself.
    left = F.lit(window - 1)  # place of the hit within the document's words
    same = F.zip_with(F.slice("around", left - F.col("pivot") + 1, F.col("size_")), "words", lambda x, y: (x == y) & (x != 0))
    joined = joined.withColumn("size_", F.size("words")).withColumn("same", same)
    pivot = F.col("pivot").cast("int")
    before = F.array_position(F.reverse(F.slice("same", 1, pivot)), False)
    after = F.array_position(F.slice("same", pivot + 2, F.greatest(F.col("size_") - pivot - 1, F.lit(0))), False)
    lo = F.when(before == 0, -pivot).otherwise(1 - before)
    hi = F.when(after == 0, F.col("size_") - pivot).otherwise(after)
    spans = joined.select(*keep, "item_id", "place", F.col("size"), F.coalesce(F.element_at("same", pivot + 1), F.lit(False)).alias("there"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    ok = F.col("there") & (F.col("hi") - F.col("lo") >= F.col("size"))
    spans = spans.select(*keep, "item_id", "place", F.when(ok, F.col("lo")).alias("lo"), "hi")
    hit = F.col("lo").isNotNull()
    grouped = spans.groupBy("uid", *[c for c in keep if c not in ("uid", "carry")]).agg(
        F.array_sort(F.collect_set(F.when(hit, F.struct((F.col("place") + F.col("lo")).alias("from"), (F.col("place") + F.col("hi")).alias("to"))))).alias("spans"),
        F.array_sort(F.collect_set(F.when(hit, F.col("item_id")))).alias("items"),
        *([F.first("carry").alias("carry")] if carry else []),
    )
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<from:bigint,to:bigint>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["to"] >= s["from"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["from"].alias("from"), F.greatest(F.element_at(acc, -1)["to"], s["to"]).alias("to"))))).otherwise(F.concat(acc, F.array(s))),
    )
    out = grouped.withColumn("spans", F.when(F.size("spans") > 0, merged).otherwise(F.col("spans")))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["to"] - s["from"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans", *["carry"] * bool(carry))
