"""Count 64-bit keys over the whole input and bring the counts back.

A row a key would cost more to move than the key itself.  So each block of
documents sorts its distinct keys into buckets and sends one array a bucket;
a bucket's task sums the counts of all blocks and answers each block with one
byte a key.  Then the answers meet the block's documents again.

A block sends each distinct key once, so one hot key costs at most one entry a
block.  Buckets are drawn from a second hash, whose bits come on top of the 64
bits of the key: two different keys fall together with probability
1 / (2**64 * buckets).  The number of buckets follows the input's bytes, so a
bucket stays within a task's memory.

Blocks are made twice, once for their keys and once for their documents, from
partitions that must hold the same rows in the same order (see
``cluster.settled``).  A block's name has a hash of its content, and answers
without documents raise an error, so a change between the two can't go unseen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attestry.llm import cluster, worker
from attestry.llm.text import Block, blocks


#: Bytes of input on disk for a bucket, and text bytes of a block.
BUCKET_BYTES, BLOCK = 1 << 20, 2 << 20


class Keys(NamedTuple):
    """Keys of a block, any number of them alike; ``side`` draws the bucket."""

    key: np.ndarray
    side: np.ndarray


class Distinct(NamedTuple):
    """Distinct keys of a block in order of (bucket, key)."""

    key: np.ndarray
    count: np.ndarray
    inverse: np.ndarray
    bounds: np.ndarray


def bucket_count(partitions: int, size: int) -> int:
    """Buckets for an input of ``size`` bytes on disk: by the input, so that a
    bucket fits a task whatever the number of partitions is."""
    return 1 << max(4, (max(4 * partitions, size // BUCKET_BYTES) - 1).bit_length())


def _short(keys: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _long(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel().astype(np.uint64)


def distinct(keys: Keys, n_buckets: int) -> Distinct:
    bucket = keys.side >> np.uint64(64 - (n_buckets.bit_length() - 1))
    order = np.lexsort((keys.key, bucket))
    key, bucket = keys.key[order], bucket[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
    heads = np.flatnonzero(new)
    inverse = np.empty(len(key), np.int64)
    inverse[order] = np.cumsum(new) - 1
    count = np.diff(np.append(heads, len(key)))
    bounds = np.searchsorted(bucket[heads], np.arange(n_buckets + 1, dtype=np.uint64))
    return Distinct(key[heads], count, inverse, bounds)


def _name(block: Block, partition: int, seq: int) -> str:
    h = xxhash.xxh3_64(block.data)
    h.update(block.offsets.tobytes())
    return f"{partition}-{seq}-{h.hexdigest()}"


def _named(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[str, Block]]:
    partition, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        for block in blocks(batch, column, BLOCK):
            yield _name(block, partition, seq), block
            seq += 1


def _pack(block: Block) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.rows.schema) as out:
        out.write_batch(block.rows)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def _unpack(data: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all().combine_chunks()
    return table.to_batches()[0]


def with_counts(
    docs: DataFrame,
    column: str,
    keys: Callable[[Block], Keys],
    finish: Callable[[Block, np.ndarray], pa.RecordBatch],
    schema: T.StructType,
    width: int = 8,
) -> DataFrame:
    """Apply ``finish(block, level)`` to each block.

    ``level`` has a byte for each key that ``keys(block)`` gives, in its order:
    0 for a key that occurs once in the whole input, else
    1 + floor(log2(occurrences)).  An array of keys with a key twice in one
    document counts both.  ``width`` keeps so many bytes of a key: fewer where two
    keys that fall together do no harm.
    """
    spark = docs.sparkSession
    cluster.prepare(spark)
    docs = cluster.settled(docs)
    n_parts = cluster.partitions(spark)
    n_buckets = bucket_count(n_parts, cluster.size_bytes(docs))
    drop = np.uint64(64 - 8 * width)

    def own_keys(block: Block) -> Distinct:
        got = keys(block)
        return distinct(Keys(got.key >> drop, got.side), n_buckets)

    def send(batches):
        for name, block in _named(batches, column):
            d = own_keys(block)
            full = np.flatnonzero(np.diff(d.bounds))
            if not len(full):
                continue
            many = np.minimum(d.count, 2**32 - 1).astype(np.uint32)
            cut = [(d.bounds[b], d.bounds[b + 1]) for b in full]
            more = [b"" if (many[i:j] == 1).all() else zstandard.compress(many[i:j].tobytes(), 1) for i, j in cut]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array([name] * len(full)), pa.array([_short(d.key[i:j], width) for i, j in cut], pa.binary()), pa.array(more, pa.binary())],
                ["bucket", "block", "keys", "counts"],
            )

    def count(table: pa.Table) -> pa.Table:
        payload = table.column("keys").to_pylist()
        sizes = np.array([len(p) // width for p in payload])
        key = _long(b"".join(payload), width)
        many = np.concatenate([np.frombuffer(zstandard.decompress(c), np.uint32) if c else np.ones(n, np.uint32) for c, n in zip(table.column("counts").to_pylist(), sizes, strict=True)]).astype(np.int64)
        order = np.argsort(key)
        ordered = key[order]
        new = np.ones(len(key), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        run = np.cumsum(new) - 1
        total = np.add.reduceat(many[order], np.flatnonzero(new))
        level = np.empty(len(key), np.uint8)
        level[order] = np.where(total > 1, np.frexp(total.astype(np.float64))[1], 0).astype(np.uint8)[run]
        ends = np.cumsum(sizes)
        hit = [i for i, (e, n) in enumerate(zip(ends, sizes, strict=True)) if level[e - n : e].any()]
        return pa.table(
            {
                "block": table.column("block").take(pa.array(hit, pa.int64())),
                "bucket": table.column("bucket").take(pa.array(hit, pa.int64())),
                "levels": pa.array([zstandard.compress(level[ends[i] - sizes[i] : ends[i]].tobytes(), 1) for i in hit], pa.binary()),
            }
        )

    def keep(batches):
        for name, block in _named(batches, column):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([_pack(block)], pa.binary())], ["block", "rows"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            raise RuntimeError("documents changed between two readings of one partition")
        worker.begin("counting")
        block = Block(_unpack(right.column("rows")[0].as_py()), column, right.column("block")[0].as_py())
        d = own_keys(block)
        level = np.zeros(len(d.key), np.uint8)
        for b, packed in zip(left.column("bucket").to_pylist(), left.column("levels").to_pylist(), strict=True):
            level[d.bounds[b] : d.bounds[b + 1]] = np.frombuffer(zstandard.decompress(packed), np.uint8)
        done = finish(block, level[d.inverse])
        del d, level, block
        worker.trim()
        return pa.Table.from_batches([done])

    sent = docs.mapInArrow(worker.tended("counting", send), "bucket int, block string, keys binary, counts binary")
    levels = sent.repartition(n_parts, "bucket").groupBy("bucket").applyInArrow(count, "block string, bucket int, levels binary")
    kept = docs.mapInArrow(worker.tended("counting", keep), "block string, rows binary")
    return levels.repartition(n_parts, "block").groupBy("block").cogroup(kept.repartition(n_parts, "block").groupBy("block")).applyInArrow(meet, schema)
