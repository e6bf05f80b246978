"""Token ids in wavelet-matrix files.

A shard file holds the ids of consecutive documents as succinct bit planes:
one plane for each bit of the largest id, from the highest down, each stably
partitioned by the plane before it, with a count of ones before each 512 bits.
One file so answers access (id at a place), count (an id's occurrences within
a range) and select (place of its k-th occurrence).

Layout, little-endian: magic ``AWM2``; ids u64; documents u64; planes u32; for
each document its id i64 (0 for a null), its length u32 and a byte, 1 for a null
id; for each plane its zeros u64; then for each plane its directory (u64 for each 512 bits and one more) and its bits
in u64 words.

``write`` puts the files into a Parquet table of one row a file, so that any
store that Spark reaches can hold them, in ascending order of document id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import cluster, worker
from attestry.llm.text import blocks
from attestry.llm.tokens import BLOCK, encoder, path

#: Ids of a file, unless one document has more.
SHARD_IDS = 4 << 20

_WORDS = 8  # words of a directory block


class WaveletMatrix:
    def __init__(self, n: int, docs: np.ndarray, lengths: np.ndarray, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray], nulls: np.ndarray | None = None):
        self.nulls = np.zeros(len(docs), bool) if nulls is None else nulls
        self.n, self.docs, self.lengths, self.zeros, self.planes, self.ranks = n, docs, lengths, zeros, planes, ranks

    @staticmethod
    def build(ids: np.ndarray, docs: np.ndarray, lengths: np.ndarray, nulls: np.ndarray | None = None) -> WaveletMatrix:
        n = len(ids)
        cur = ids.astype(np.uint16 if n == 0 or ids.max() < 1 << 16 else np.uint32)
        width = max(1, int(ids.max()).bit_length() if n else 1)
        zeros, planes, ranks = [], [], []
        for b in range(width - 1, -1, -1):
            bit = (cur >> b) & 1 == 1
            packed = np.zeros(-(-max(n, 1) // 512) * 64, np.uint8)
            packed[: -(-n // 8)] = np.packbits(bit, bitorder="little")
            words = packed.view(np.uint64)
            planes.append(words)
            ones = np.bitwise_count(words).reshape(-1, _WORDS).sum(axis=1, dtype=np.uint64)
            ranks.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones)]))
            low = np.flatnonzero(~bit)  # taking places is faster than taking by a mask
            zeros.append(len(low))
            cur = np.concatenate([cur.take(low), cur.take(np.flatnonzero(bit))])
        return WaveletMatrix(n, docs, lengths, zeros, planes, ranks, nulls)

    def tobytes(self) -> bytes:
        head = b"AWM2" + struct.pack("<QQI", self.n, len(self.docs), len(self.planes))
        parts = [head, self.docs.astype("<i8").tobytes(), self.lengths.astype("<u4").tobytes(), self.nulls.astype(np.uint8).tobytes(), np.array(self.zeros, "<u8").tobytes()]
        for rank, plane in zip(self.ranks, self.planes, strict=True):
            parts += [rank.astype("<u8").tobytes(), plane.astype("<u8").tobytes()]
        return b"".join(parts)

    @staticmethod
    def frombytes(data: bytes) -> WaveletMatrix:
        if data[:4] != b"AWM2":
            raise ValueError("not a wavelet file")
        n, n_docs, width = struct.unpack_from("<QQI", data, 4)
        at = 24

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        docs, lengths, nulls = take("<i8", n_docs), take("<u4", n_docs), take("u1", n_docs).astype(bool)
        zeros = [int(z) for z in take("<u8", width)]
        blocks_ = -(-max(n, 1) // 512)
        planes, ranks = [], []
        for _ in range(width):
            ranks.append(take("<u8", blocks_ + 1))
            planes.append(take("<u8", blocks_ * _WORDS))
        return WaveletMatrix(n, docs, lengths, zeros, planes, ranks, nulls)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place of a plane."""
        word, plane = at >> 6, self.planes[level]
        out = self.ranks[level][at >> 9].astype(np.int64)
        for i in range(_WORDS - 1):
            spot = (at >> 9) * _WORDS + i
            out += np.where(spot < word, np.bitwise_count(plane[np.minimum(spot, len(plane) - 1)]), 0)
        inside = plane[np.minimum(word, len(plane) - 1)] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return out + np.bitwise_count(inside)

    def access(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.int64)
        for level, zero in enumerate(self.zeros):
            bit = (self.planes[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(level, at)
            out = out * 2 + bit
            at = np.where(bit, zero + ones, at - ones)
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        ends = np.array([lo, hi], np.int64)
        for level, zero in enumerate(self.zeros):
            ones = self._ones(level, ends)
            ends = zero + ones if token >> (len(self.zeros) - 1 - level) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in places lo up to hi."""
        if token >> len(self.zeros):
            return 0
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence of an id, counted from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, 0, self.n)[0] + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one, zero = token >> (len(self.zeros) - 1 - level) & 1, self.zeros[level]
            want = at - zero if one else at
            lo, hi = 0, self.n  # smallest place with want + 1 such bits up to and with it
            while lo < hi:
                mid = (lo + hi) // 2
                ones = int(self._ones(level, np.array([mid + 1], np.int64))[0])
                if (ones if one else mid + 1 - ones) > want:
                    hi = mid
                else:
                    lo = mid + 1
            at = lo
        return at

    def find(self, token: int) -> list[int]:
        """All places of an id."""
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, by undoing the partitions from the last plane to the first."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~bit)] = out[: self.zeros[level]]
            up[np.flatnonzero(bit)] = out[self.zeros[level] :] | kind(1 << (len(self.zeros) - 1 - level))
            out = up
        return out.astype(np.uint32)


def write(docs: DataFrame, folder: str, id_column: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k.json", end_id: int = 0) -> None:
    """Encode every document, add ``end_id`` and write the files.

    A null text is an empty one.  Rows with a null id come first and keep it;
    rows of one id follow each other in order of their texts.  An empty table
    gives a table without files.
    """
    spark = docs.sparkSession
    cluster.prepare(spark)
    flat = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    spread = flat.repartitionByRange(cluster.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path(name)), TaskContext.get().partitionId()
        start = seq = held = 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[int] = []

        def flush():
            matrix = WaveletMatrix.build(np.concatenate(ids), np.array([i or 0 for i in names], np.int64), np.array(sizes, np.int64), np.array([i is None for i in names], bool))
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([start]), pa.array([held]), pa.array([matrix.tobytes()], pa.binary())], ["part", "seq", "start", "n_ids", "file"])

        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                got = enc.block(block)
                for i, doc in enumerate(block.rows.column("doc_id").to_pylist()):
                    one = np.append(got.values[got.bounds[i] : got.bounds[i + 1]], np.uint32(end_id))
                    if held and held + len(one) > SHARD_IDS:
                        yield flush()
                        start, seq, held, ids, names, sizes = start + held, seq + 1, 0, [], [], []
                    ids.append(one)
                    names.append(doc)
                    sizes.append(len(one))
                    held += len(one)
        if ids:
            yield flush()

    spread.mapInArrow(worker.tended("tokens", files), "part long, seq long, start long, n_ids long, file binary").write.mode("append").option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents from the files: ``doc_id``, ``start``, ``n_tokens``,
    ``ids_crc32`` and, if asked for, ``ids``."""
    table = spark.read.schema("part long, seq long, start long, n_ids long, file binary").parquet(folder)
    sums = sorted((r.part, r.n) for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row for each partition
    base, before = {}, 0
    for part, n in sums:
        base[part], before = before, before + n

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, file in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), batch.column("file"), strict=True):
                matrix = WaveletMatrix.frombytes(file.as_buffer().to_pybytes())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(matrix.lengths, dtype=np.int64)
                view = memoryview(ids).cast("B")
                begins = ends - matrix.lengths
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                out = [pa.array(matrix.docs, mask=matrix.nulls), pa.array(begins + start + base[part]), pa.array(matrix.lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(begins, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return table.mapInArrow(worker.tended("wavelet", rows), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
