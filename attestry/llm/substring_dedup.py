"""Exact substring dedup: words covered by a repeated window are removed.

Every window of ``window`` consecutive words of one document gets a
Rabin-Karp hash.  All hashes are counted in Spark (``counting``); windows whose
hash starts at two or more places merge into maximal removal intervals.
Windows are judged on the input, so of a passage that occurs twice both copies
go.

Null and empty texts, and texts shorter than a window, have no window and lose
nothing.  Repeated rows are repeated texts.  An empty table gives an empty
result.  Columns other than the two named are carried along in ``carry`` or
left out, so that their names never clash.  Texts of any length are treated
whole.

Two different windows are taken for one with probability 1 / (2**64 * buckets),
with at least four buckets for each shuffle partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.counting import Keys, with_counts
from attestry.llm.text import SPACED, Block, Words, join_words, text_array, windows

WINDOW = 35


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ("doc_id",), tidy: bool = True) -> DataFrame:
    """One row per document.

    ``carry`` (a struct of the columns named), ``kept_text`` (kept words joined
    by one space), ``n_words``, ``n_removed`` and ``removed`` (intervals of
    word places, from and up to).  Without ``tidy`` a text that loses nothing
    stays as it is, null included.
    """
    flat = docs.select(F.col(text).alias("text"), F.struct(*[F.col(c) for c in carry]).alias("carry"))
    span = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])
    schema = T.StructType(
        [flat.schema["carry"], T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(span))]
    )

    def keys(block: Block) -> Keys:
        words = Words(block, SPACED, lower=False)
        hashes = words.hashes()
        at, key = windows(words, hashes, window)
        return Keys(key, windows(words, hashes, window, side=True)[1])

    def finish(block: Block, level: np.ndarray) -> pa.RecordBatch:
        words = Words(block, SPACED, lower=False)
        starts = np.arange(len(words))[np.arange(len(words)) + window <= words.stop()]
        again = starts[level > 0]
        edge = np.zeros(len(words) + 1, np.int64)
        edge[again] += 1
        np.add.at(edge, again + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        removed = before[words.first[1:]] - before[words.first[:-1]]
        opened = gone & ~np.concatenate([[False], gone[:-1]])
        shut = gone & ~np.concatenate([gone[1:], [False]])
        row_head = np.zeros(len(words) + 1, bool)
        row_head[words.first[:-1]] = True
        opened |= gone & row_head[:-1]
        shut |= gone & row_head[1:]
        lo, hi = np.flatnonzero(opened), np.flatnonzero(shut) + 1
        per_row = np.searchsorted(lo, words.first)
        base = np.repeat(words.first[:-1], np.diff(per_row))
        spans = pa.ListArray.from_arrays(pa.array(per_row.astype(np.int32)), pa.StructArray.from_arrays([pa.array(lo - base), pa.array(hi - base)], ["from", "to"]))
        data, bounds = join_words(words, ~gone)
        kept = text_array(data, bounds)
        if not tidy:
            kept = pc.if_else(pa.array(removed == 0), block.rows.column("text").cast(pa.string()), kept)
        return pa.RecordBatch.from_arrays(
            [block.rows.column("carry"), kept, pa.array(words.counts), pa.array(removed), spans],
            ["carry", "kept_text", "n_words", "n_removed", "removed"],
        )

    return with_counts(flat, "text", keys, finish, schema)
