"""Importance resampling towards a target distribution of hashed n-grams.

Features of a text are its runs of 1 to ``longest`` words, counted in ``BUCKETS``
buckets.  A bucket's gain is the smoothed log-ratio of its share in the target to
its share in the corpus, in thousandths; a document's weight is the floored mean
gain of its features, and a Gumbel variate drawn from its id turns the highest
scores into a sample without replacement in proportion to the weights.

Nothing but totals is shuffled to score: a first scan counts buckets, added up in
each task before the shuffle, and a second one scores each text where it lies.
Higher-order functions make the array of its buckets and sum up ``element_at`` of
the gains, which are a literal of the plan (one number a bucket).  All of it
stays in the JVM; no row is exploded to score a text.

Ranks come from the histogram of scores.  A score is a whole number between about
-100000 and 120000 whatever the input's size, so the histogram is bounded and is
broadcast; only documents at or above the cut are shuffled, by score, which the
Gumbel variate spreads.

Null and empty texts have no features and weight 0; texts of any length are taken
whole.  Equal scores rank by id, nulls last, then by features and weight;
repeated rows are documents of their own.  A null id draws as an empty one.  With
an empty table or target all counts are 0 and the gains follow from the smoothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.numbers import bound
from attestry.llm import cluster

BUCKETS = 10_000

#: What stands between words: all of ASCII but letters and digits.
_BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of letters and digits of ASCII, and of all that lies beyond ASCII, in lower case."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN)))
    return bound(plain, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " +")))


def buckets(spoken: Column, longest: int = 2, size: int = BUCKETS) -> Column:
    """The bucket of each run of 1 to ``longest`` of the words, repeats included."""
    number = lambda run: (F.crc32(run.cast("binary")) % size).cast("int")

    def runs(n: int) -> Column:
        starts = F.slice(spoken, F.lit(1), F.greatest(F.size(spoken) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda w, i: number(F.concat(w, *[part for k in range(1, n) for part in (F.lit(" "), spoken[i + k])])))

    return F.concat(*[runs(n) for n in range(1, longest + 1)])


def totals(rows: DataFrame, text: str = "text", longest: int = 2, size: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket.

    The words are bound to a lambda's variable here and below.  The optimizer may put
    a column's expression in each place that reads it, inside lambdas too, where it
    would run once for each word.
    """
    each = rows.select(F.explode(bound(words(F.col(text)), lambda w: buckets(w, longest, size))).alias("bucket"))
    out = np.zeros(size, np.int64)
    for r in each.groupBy("bucket").count().collect():  # ``size`` rows at most
        out[r["bucket"]] = r["count"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the target's share over the corpus's share), both with one feature more a bucket."""
    size = len(corpus)
    whole, wanted = float(corpus.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log(float(t + 1) * whole / (float(s + 1) * wanted))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: Sequence[int], text: str = "text", keep: Sequence[str] = ("doc_id",), longest: int = 2) -> DataFrame:
    """``keep``, ``n_words``, ``n_features`` and ``weight`` of each row."""
    table, zero = F.lit(np.asarray(gain, np.int64)), F.lit(0).cast("long")
    summed = lambda found: F.aggregate(found, zero, lambda total, b: total + F.element_at(table, b + 1))
    scored = lambda w, found: F.struct(F.size(w).cast("long").alias("n_words"), F.size(found).cast("long").alias("n_features"), summed(found).alias("gain"))
    each = docs.select(*keep, bound(words(F.col(text)), lambda w: bound(buckets(w, longest, len(gain)), lambda found: scored(w, found))).alias("s"))
    each = each.select(*keep, "s.n_words", "s.n_features", "s.gain")
    floored = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(0)
    return each.select(*keep, "n_words", "n_features", floored.cast("long").alias("weight"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """A Gumbel variate in thousandths, floored, from the first 32 bits of SHA-256 of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, percent: int, eligible: Column, doc_id: str = "doc_id") -> DataFrame:
    """The rows with a ``rank`` for the ``percent`` of eligible ones with the highest ``score``."""
    scored = scored.withColumn("_may", F.coalesce(eligible, F.lit(False)))
    falling = Window.orderBy(F.desc("score"))
    hist = scored.where("_may").groupBy("score").agg(F.count("*").alias("n"))
    hist = hist.select("score", (F.sum("n").over(falling) - F.col("n")).alias("_above"), F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).cast("long").alias("_draw"))
    may = scored.where("_may").join(F.broadcast(hist), "score")
    rank = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last(doc_id), "n_features", "weight")) + F.col("_above")
    high = may.where("_above < _draw").withColumn("rank", F.when(rank <= F.col("_draw"), rank).cast("long"))
    low = may.where("_above >= _draw").unionByName(scored.where("not _may").withColumns({"_above": F.lit(0).cast("long"), "_draw": F.lit(0).cast("long")}))
    return high.unionByName(low.withColumn("rank", F.lit(None).cast("long"))).drop("_may", "_above", "_draw")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn) of each document."""
    cluster.prepare(docs.sparkSession)
    gain = gains(totals(docs, text), totals(target, target_text))
    scored = weighted(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), gain)
    scored = cluster.written(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scores")
    return drawn(scored, percent, F.col("n_words") >= min_words)
