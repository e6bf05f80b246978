"""Sum-of-squares online packing of token sequences.

Documents longer than a window fill whole windows first.  What is left of each
document goes, in order of arrival, to the fill level that keeps the sum of
squared counts of partially filled windows smallest; a level array has these
counts, and a stack for each level has its windows.  Each task packs its own
partition.  When ``MAX_OPEN`` windows are open they are joined: documents may be
cut, so pieces of the emptiest fill up the fullest, and one open window at most is
left.  At the partition's end this last one is cut into sequences whose lengths
are powers of two, which need no padding.

A null or empty text is its end id alone.  Repeated rows are packed each for
itself; rows with a null id keep it.  Other columns are left out.  An empty
table has no sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import cluster, worker
from attestry.llm.text import blocks
from attestry.llm.tokens import BLOCK, encoder, path

CAPACITY = 4096

#: Open windows of a task (16 MB of ids at most).
MAX_OPEN = 1024


class Packer:
    """Windows of one task; a piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]

    def place(self, piece: tuple) -> list | None:
        """Add a piece shorter than a window; returns a window it filled."""
        size, n, cap = len(piece[2]), self.levels, self.capacity
        # Growth of the sum if a window of level h takes the piece; a full window counts no more.
        gain = np.full(cap - size + 1, np.iinfo(np.int64).max)
        has = n[: cap - size + 1] > 0
        gain[has] = 2 * (n[size : cap + 1][has] - n[: cap - size + 1][has]) + 2
        gain[0] = 2 * n[size] + 1
        if has[cap - size]:
            gain[cap - size] = 1 - 2 * n[cap - size]
        # Among equals the fullest window.
        h = cap - size - int(np.argmin(gain[::-1]))
        if h:
            n[h] -= 1
            window = self.open[h].pop()
        else:
            window = []
        window.append(piece)
        if h + size == cap:
            return window
        n[h + size] += 1
        self.open[h + size].append(window)
        return None

    def rest(self, last: bool = True) -> Iterator[list]:
        """Close what is open: full windows, then powers of two, or unless it is
        the ``last`` time one open window."""
        pieces = [p for level in range(self.capacity, 0, -1) for window in self.open[level] for p in window]
        self.levels[:] = 0
        self.open = [[] for _ in range(self.capacity + 1)]
        total = sum(len(p[2]) for p in pieces)
        sizes, over = [self.capacity] * (total // self.capacity), total % self.capacity
        if last:
            sizes += [1 << b for b in range(self.capacity.bit_length(), -1, -1) if over >> b & 1]
        pieces.reverse()
        for size in sizes:
            window = []
            while size:
                doc, start, ids, tokens = pieces.pop()
                if len(ids) > size:
                    pieces.append((doc, start + size, ids[size:], tokens))
                    ids = ids[:size]
                window.append((doc, start, ids, tokens))
                size -= len(ids)
            yield window
        if not last and over:
            self.levels[over] = 1
            self.open[over].append(pieces[::-1])


def pack(docs: DataFrame, id_column: str = "doc_id", text: str = "text", name: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: ``doc_id``, ``start``, ``length``, ``ids`` (bytes
    of little-endian unsigned 32-bit ids), ``doc_tokens``, ``sequence_id``,
    ``offset``."""
    cluster.prepare(docs.sparkSession)
    flat = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    kind = flat.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, seq = encoder(path(name)), Packer(capacity), TaskContext.get().partitionId() << 40
        out: list[tuple] = []

        def emit(window: list) -> None:
            nonlocal seq
            at = 0
            for doc, start, ids, tokens in window:
                out.append((doc, start, len(ids), ids.tobytes(), tokens, seq, at))
                at += len(ids)
            seq += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            kinds = [schema_id[0], pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        schema_id = [pa.int64()]
        for batch in batches:
            schema_id[0] = batch.schema.field("doc_id").type
            for block in blocks(batch, "text", BLOCK):
                got = enc.block(block)
                for i, doc in enumerate(block.rows.column("doc_id").to_pylist()):
                    ids = np.append(got.values[got.bounds[i] : got.bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    whole = len(ids) - len(ids) % capacity
                    for at in range(0, whole, capacity):
                        emit([(doc, at, ids[at : at + capacity], len(ids))])
                    if whole < len(ids):
                        full = packer.place((doc, whole, ids[whole:], len(ids)))
                        if full:
                            emit(full)
                        elif packer.levels.sum() >= MAX_OPEN:
                            for window in packer.rest(last=False):
                                emit(window)
                if len(out) >= 2000:
                    yield flush()
        for window in packer.rest():
            emit(window)
            if len(out) >= 2000:
                yield flush()
        if out:
            yield flush()

    return flat.mapInArrow(worker.tended("tokens", rows), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
