"""Toxicity: a logistic regression that must not mind which group a sentence names.

Features are the distinct character n-grams of a text's words (4 to 6 code points;
a word's borders count as spaces), hashed into 2**20 buckets.  They need no list of
insults and find stems with any ending.  Of the buckets, the ``features`` most
strongly tied to either label take part.

Counterfactual regularisation: each sentence of a labelled text that names a group
(``GROUPS``) is rewritten with other names of the same kind, and the loss has the
squared difference of the two scores, before the logistic function:

    mean log-loss + ridge / 2 * |w|^2 + fairness * mean (w . (x' - x))^2

So words that stand for people get no weight of their own, though they may be more
frequent in toxic texts, and neutral mentions stay clean.

The labelled rows are a bounded sample (``max_rows``, by a hash of the id; all of
them, where there are fewer).  One pass over it counts buckets by label, one makes
sparse rows; L-BFGS then asks the executors for loss and gradient of all rows, of
which ``features`` + 1 numbers a task come back.  Scores need no shuffle: whole
texts, a slab of code points at a time, against a broadcast table of 2**20 entries.

A row with several labels counts as toxic if one of them says so; null labels are
left out.  Repeated rows count each, in training and in the result.  Null and empty
texts have no feature, so that their score follows from the share of toxic rows.
Without any labelled row all scores are 1/3.  A null id is not held out and has no
label.  Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import cluster, worker
from attestry.llm.language_id import is_held_out, points
from attestry.llm.text import Block, blocks

LENGTHS = (4, 5, 6)
BUCKETS = 1 << 20
FEATURES = 4096
MAX_ROWS = 50_000
LEAST = 3
RIDGE, FAIRNESS = 5e-5, 1.0
SWAPS, ROUNDS = 2, 40
_SLAB, _CHUNK, _SPACE = 1 << 19, 1 << 12, 0x20

#: Names of people by kind; a name is swapped for others of its line only.
GROUPS = (
    ("woman", "man"),
    ("women", "men"),
    ("girl", "boy"),
    ("girls", "boys"),
    ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("african", "american", "european", "chinese", "mexican", "indian"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("immigrant", "refugee", "citizen", "tourist"),
    ("immigrants", "refugees", "citizens", "tourists"),
    ("disabled", "blind", "deaf", "autistic"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
)


class Model(NamedTuple):
    """Buckets in ascending order, their weights, and the constant."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def present(block: Block, lookup: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of row and bucket, in order; with ``lookup`` only buckets that
    have a feature there, by its number."""
    cp, bounds, _ = points(block)
    n = len(block)
    row = np.repeat(np.arange(n), np.diff(bounds))
    padded = np.full(len(cp) + n + 1, _SPACE, np.uint64)  # rows with a space before, between and after
    padded[np.arange(len(cp)) + row + 1] = cp
    starts = bounds[:-1] + np.arange(n)
    gap = padded == _SPACE
    found = []
    for lo in range(0, len(padded), _SLAB):
        for size in LENGTHS:
            part = padded[lo : lo + _SLAB + size - 1]
            count = len(part) - size + 1
            if count <= 0:
                continue
            h = np.full(count, size, np.uint64)
            inner = np.zeros(count, bool)
            for i in range(size):
                h = (h ^ part[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
                if 0 < i < size - 1:
                    inner |= gap[lo + i : lo + i + count]
            at = (h >> np.uint64(64 - 20)).astype(np.int32)
            if lookup is not None:
                at = lookup[at]
                inner |= at < 0
            keep = np.flatnonzero(~inner)
            owner = np.searchsorted(starts, keep + lo, "right") - 1
            found.append(np.unique((owner << 20) | at[keep]))
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys >> 20, keys & (BUCKETS - 1)


@lru_cache(4)
def _names(groups: tuple[tuple[str, ...], ...]) -> tuple[re.Pattern, dict[str, tuple[str, ...]]]:
    """Each name with the others of its kind, beginning after it."""
    others = {name: (*line[i + 1 :], *line[:i]) for line in groups for i, name in enumerate(line)}
    return re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, others), key=len, reverse=True)) + r")(?!\w)"), others


def swapped(text: str, groups: Sequence[Sequence[str]] = GROUPS, swaps: int = SWAPS) -> list[tuple[str, str]]:
    """Sentences that name a group, each with rewritten ones."""
    pattern, others = _names(tuple(map(tuple, groups)))
    out = []
    for sentence in re.split(r"[.!?\n]+", text.lower()):
        names = pattern.findall(sentence)
        for shift in range(min(swaps, max((len(others[n]) for n in names), default=0))):
            out.append((sentence, pattern.sub(lambda m, shift=shift: others[m[0]][shift % len(others[m[0]])], sentence)))
    return out


def _texts(values: Sequence[str]) -> Block:
    return Block(pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["text"]), "text")


def select(labelled: DataFrame, n_toxic: int, n_rows: int, features: int = FEATURES) -> np.ndarray:
    """The buckets whose share of rows differs most between the labels, by its chi-square."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            for block in blocks(batch, "text"):
                row, bucket = present(block)
                toxic = block.rows.column("toxic").to_numpy(zero_copy_only=False).astype(bool)[row]
                sums[0] += np.bincount(bucket[~toxic], minlength=BUCKETS).astype(np.int32)
                sums[1] += np.bincount(bucket[toxic], minlength=BUCKETS).astype(np.int32)
        used = np.flatnonzero(sums.reshape(2, -1, _CHUNK).any(axis=(0, 2)))
        for c in used:
            cut = sums[:, c * _CHUNK : (c + 1) * _CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([cut.tobytes()], pa.binary())], ["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((2, _CHUNK), np.int64)
        for c in table.column("counts"):
            total += np.frombuffer(c.as_buffer(), np.int32).reshape(2, _CHUNK)
        base = table.column("chunk")[0].as_py() * _CHUNK
        clean, toxic = total
        both, n = clean + toxic, float(n_rows)
        left, right = max(n_toxic, 1), max(n_rows - n_toxic, 1)
        share = np.clip(both / n, 1e-9, 1 - 1e-9)
        chi = (toxic / left - clean / right) ** 2 / (share * (1 - share) * (1 / left + 1 / right))
        at = np.flatnonzero((both >= LEAST) & (chi > 4))
        return pa.table({"bucket": pa.array(base + at, pa.int32()), "chi": pa.array(chi[at], pa.float64())})

    parts = labelled.mapInArrow(worker.tended("toxicity", count), "chunk int, counts binary")
    best = parts.groupBy("chunk").applyInArrow(add, "bucket int, chi double").orderBy(F.desc("chi"), "bucket").limit(features)
    return np.sort(np.array([r.bucket for r in best.collect()], np.int32))  # ``features`` rows


def _lookup(buckets: np.ndarray) -> np.ndarray:
    out = np.full(BUCKETS, -1, np.int32)
    out[buckets] = np.arange(len(buckets), dtype=np.int32)
    return out


def sparse(labelled: DataFrame, buckets: np.ndarray, groups: Sequence[Sequence[str]] = GROUPS, swaps: int = SWAPS) -> DataFrame:
    """``kind`` (0 or 1: the label; 2: a difference of two sentences), feature
    numbers as 16-bit integers, and of differences their signs."""
    sent = labelled.sparkSession.sparkContext.broadcast(buckets)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(sent.value)
        pattern, _ = _names(tuple(map(tuple, groups)))
        for batch in batches:
            for block in blocks(batch, "text"):
                n = len(block)
                row, feature = present(block, lookup)
                cuts = np.searchsorted(row, np.arange(n + 1))
                kinds = block.rows.column("toxic").to_pylist()
                numbers = [feature[a:b].astype("<i2").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                signs: list[bytes | None] = [None] * n
                pairs = [p for text in block.rows.column("text").to_pylist() if text and pattern.search(text.lower()) for p in swapped(text, groups, swaps)]
                if pairs:
                    row, feature = present(_texts([s for p in pairs for s in p]), lookup)
                    for i in range(len(pairs)):
                        was, new = (set(feature[np.searchsorted(row, j) : np.searchsorted(row, j + 1)].tolist()) for j in (2 * i, 2 * i + 1))
                        gone, come = sorted(was - new), sorted(new - was)
                        kinds.append(2)
                        numbers.append(np.array(gone + come, "<i2").tobytes())
                        signs.append(np.array([-1] * len(gone) + [1] * len(come), np.int8).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(numbers, pa.binary()), pa.array(signs, pa.binary())], ["kind", "numbers", "signs"])

    return labelled.mapInArrow(worker.tended("toxicity", rows), "kind int, numbers binary, signs binary")


def gradient(rows: DataFrame, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows at ``theta`` (weights, then the constant): log-loss and
    squared differences, and the gradients of both."""
    sent = rows.sparkSession.sparkContext.broadcast(theta)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta = sent.value
        weights, bias, k = theta[:-1], theta[-1], len(theta) - 1
        loss, grad = np.zeros(2), np.zeros((2, k + 1))
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            raw = batch.column("numbers").to_pylist()
            index = np.frombuffer(b"".join(raw), "<i2").astype(np.int64)
            size = np.array([len(x) // 2 for x in raw])
            own = np.repeat(np.arange(len(raw)), size)
            sign = np.ones(len(index))
            for i in np.flatnonzero(kind == 2):
                sign[own.searchsorted(i) : own.searchsorted(i, "right")] = np.frombuffer(batch.column("signs")[int(i)].as_py(), np.int8)
            dot = np.bincount(own, weights[index] * sign, len(raw))
            z = np.where(kind == 1, dot + bias, -(dot + bias))
            real, gap = kind < 2, kind == 2
            loss += np.logaddexp(0, -z)[real].sum(), (dot[gap] ** 2).sum()
            pull = np.where(real, np.where(kind == 1, -1.0, 1.0) / (1 + np.exp(np.clip(z, -500, 500))), 0.0)
            grad[0, :k] += np.bincount(index, pull[own], k)
            grad[0, k] += pull.sum()
            grad[1, :k] += np.bincount(index, np.where(gap, 2 * dot, 0.0)[own] * sign, k)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([np.concatenate([loss, grad.ravel()]).tobytes()], pa.binary())], ["part", "sums"])

    parts = rows.mapInArrow(worker.tended("toxicity", part), "part long, sums binary").collect()  # one row a task of the bounded sample
    sent.destroy()
    total = np.sum([np.frombuffer(r.sums, np.float64) for r in sorted(parts, key=lambda r: r.part)], axis=0) if parts else np.zeros(2 + 2 * len(theta))
    return total[:2], total[2:].reshape(2, -1)


def fit(rows: DataFrame, k: int, n_toxic: int, n_rows: int, n_gaps: int, ridge: float = RIDGE, fairness: float = FAIRNESS, rounds: int = ROUNDS) -> np.ndarray:
    """L-BFGS from the prior; the constant is drawn to it, weights to 0."""
    start = np.zeros(k + 1)
    start[-1] = np.log((n_toxic + 1) / (n_rows - n_toxic + 2))
    if not n_rows or not k:
        return start
    pull = np.full(k + 1, ridge)
    pull[-1] = 1e-3 * ridge

    def at(theta: np.ndarray) -> tuple[float, np.ndarray]:
        loss, grad = gradient(rows, theta)
        off = theta - start
        gaps = fairness / max(n_gaps, 1)
        return loss[0] / n_rows + gaps * loss[1] + (pull * off * off).sum() / 2, grad[0] / n_rows + gaps * grad[1] + pull * off

    theta, (value, slope), steps = start, at(start), []
    for _ in range(rounds):
        q, stack = slope.copy(), []
        for s, y in reversed(steps):
            a = s @ q / (s @ y)
            q -= a * y
            stack.append(a)
        q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(np.linalg.norm(slope), 1e-12)
        for (s, y), a in zip(steps, reversed(stack), strict=True):
            q += s * (a - y @ q / (s @ y))
        length = 1.0
        while True:
            tried = theta - length * q
            new, new_slope = at(tried)
            if new <= value - 1e-4 * length * (slope @ q) or length < 1e-4:
                break
            length /= 3
        s, y = tried - theta, new_slope - slope
        done = value - new < 1e-7 * max(value, 1e-12)
        if s @ y > 1e-14:
            steps = [*steps[-9:], (s, y)]
        if new < value:
            theta, value, slope = tried, new, new_slope
        if done:
            break
    return theta


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, features: int = FEATURES, groups: Sequence[Sequence[str]] = GROUPS, swaps: int = SWAPS, ridge: float = RIDGE, fairness: float = FAIRNESS) -> Model:
    """Fit on labelled rows that are not held out, about ``max_rows`` ids at most."""
    if features >= 1 << 15:
        raise ValueError("feature numbers have 15 bits")
    spark = docs.sparkSession
    cluster.prepare(spark)
    known = labels.where(F.col(label).isNotNull() & ~F.coalesce(is_held_out(F.col(id_column)), F.lit(True))).groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    # The sample of ids is bounded by max_rows, so the texts stay where they are.
    labelled = texts.join(F.broadcast(known), "id").select("id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    parts = max(1, min(cluster.partitions(spark), 24))
    labelled = cluster.written(labelled.repartition(parts, "id").drop("id"), "labelled")
    n_rows, n_toxic = labelled.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_rows:
        return Model(np.zeros(0, np.int32), np.zeros(0), float(np.log(1 / 2)))
    buckets = select(labelled, n_toxic, n_rows, features)
    rows = cluster.written(sparse(labelled, buckets, groups, swaps), "sparse")
    n_gaps = rows.where("kind = 2").count()
    theta = fit(rows, len(buckets), n_toxic, n_rows, n_gaps, ridge, fairness)
    cluster.dropped(labelled, rows)
    return Model(buckets, theta[:-1], float(theta[-1]))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of each row."""
    spark = docs.sparkSession
    cluster.prepare(spark)
    sent = spark.sparkContext.broadcast(model)
    flat = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(sent.value.buckets)
        weights = np.append(sent.value.weights, 0.0)
        for batch in batches:
            for block in blocks(batch, "text"):
                row, feature = present(block, lookup)
                z = np.bincount(row, weights[feature], len(block)) + sent.value.bias
                yield pa.RecordBatch.from_arrays([block.rows.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    return flat.mapInArrow(worker.tended("toxicity", rows), f"doc_id {flat.schema['doc_id'].dataType.simpleString()}, score double")
