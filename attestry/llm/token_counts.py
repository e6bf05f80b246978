"""Token counts by a two-tier lookup on the map side.

Tier one is a compact hash table of frequent pre-tokens and their token
lengths, broadcast to all workers.  It is made from all documents: each task
keeps a Misra-Gries summary of its pre-tokens, summaries are added up pairwise
on the executors (never more than ``TABLE`` entries each), and the driver gets
one summary of at most ``TABLE`` entries, encodes each entry once and sends two
arrays, hashes and lengths by slot (10 bytes a slot, two slots an entry).  Tier two is the worker's cache; only
its misses are encoded.  No pre-token is ever shuffled.  The table only saves
time: a pre-token that is missing from it is encoded and counted alike.

A null or empty text has no token.  Texts are counted whole.  Repeated rows give
repeated rows, an empty table an empty result; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import cluster, worker
from attestry.llm.text import blocks
from attestry.llm.tokens import BLOCK, encoder, path

#: Entries of the broadcast table and of each summary.
TABLE = 1 << 15


def add(a: dict[str, int], b: dict[str, int], size: int) -> dict[str, int]:
    """The sum of two Misra-Gries summaries, of at most ``size`` entries."""
    out = dict(a)
    for k, v in b.items():
        out[k] = out.get(k, 0) + v
    if len(out) > size:
        level = sorted(out.values(), reverse=True)[size]
        out = {k: v - level for k, v in out.items() if v > level}
    return out


def frequent(docs: DataFrame, text: str, name: str, size: int = TABLE) -> dict[str, int]:
    """Frequent pre-tokens of all documents, with a lower bound of their counts."""

    def summary(batches):
        enc, found = encoder(path(name)), {}
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                texts = [enc.normal(block.text(i).decode()) for i in range(len(block))]
                joined, start, end, _ = enc.split(texts)
                _, first, many = np.unique(enc.hash_pieces(joined, start, end), return_index=True, return_counts=True)
                if len(many) > size:
                    many = many - np.partition(many, len(many) - size - 1)[len(many) - size - 1]
                top = np.flatnonzero(many > 0)
                found = add(found, {joined[start[first[i]] : end[first[i]]]: int(many[i]) for i in top}, size)
        yield pa.RecordBatch.from_arrays([pa.array([list(found)], pa.list_(pa.string())), pa.array([list(found.values())], pa.list_(pa.int64()))], ["piece", "count"])

    def merge(rows):
        found: dict[str, int] = {}
        for row in rows:
            found = add(found, dict(zip(row.piece, row.count_, strict=True)), size)
        yield found

    rows = docs.select(F.col(text).alias("text")).mapInArrow(worker.tended("tokens", summary), "piece array<string>, count array<bigint>").withColumnRenamed("count", "count_").rdd
    return rows.mapPartitions(merge).treeReduce(lambda a, b: add(a, b, size), depth=3) if rows.getNumPartitions() else {}


def hash_table(keys: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and lengths in slots by the key's top bits or the slot beside it; 0 is
    an empty slot.  A key without room is left out, which costs time only."""
    bits = max(1, (2 * size - 1).bit_length())
    slots, values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint16)
    for side in (0, 1):
        at = (keys >> np.uint64(64 - bits)).astype(np.int64) ^ side
        free = np.flatnonzero(slots[at] == 0)
        spot, first = np.unique(at[free], return_index=True)
        slots[spot], values[spot] = keys[free[first]], lengths[free[first]]
        keys, lengths = np.delete(keys, free[first]), np.delete(lengths, free[first])
    return slots, values


def looked_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Length of each key, -1 for a miss."""
    slots, values = table
    at = (keys >> np.uint64(64 - (len(slots).bit_length() - 1))).astype(np.int64)
    beside = at ^ 1
    return np.where(slots[at] == keys, values[at].astype(np.int64), np.where(slots[beside] == keys, values[beside].astype(np.int64), -1))


def frequent_lengths(pieces: list[str], name: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The table of pre-tokens, each encoded once, on the driver."""
    enc = encoder(path(name))
    ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
    keys = enc.hash_pieces("".join(pieces), np.append(0, ends[:-1])[: len(ends)], ends) if pieces else np.zeros(0, np.uint64)
    lengths = enc.encode_pieces(pieces)[1].astype(np.int64)
    ok = (keys != 0) & (lengths < 1 << 16)
    return hash_table(keys[ok], lengths[ok], size)


def count_tokens(docs: DataFrame, id_column: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k.json", limit: int = 1024, table: int = TABLE) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` for each row."""
    spark = docs.sparkSession
    cluster.prepare(spark)
    flat = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    sent = spark.sparkContext.broadcast(frequent_lengths(sorted(frequent(docs, text, name, table)), name, table))

    def count(batches):
        enc = encoder(path(name))
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                n = enc.block(block, lambda keys: looked_up(sent.value, keys), lengths=True).values
                yield pa.RecordBatch.from_arrays([block.rows.column("doc_id"), pa.array(np.diff(block.offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = flat.schema["doc_id"].dataType.simpleString()
    return flat.mapInArrow(worker.tended("tokens", count), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
