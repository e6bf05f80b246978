"""Text retrieval over chunks: keyword scores, TF-IDF, intents, context."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.numbers import bound, half_up
from attestry.functions.text import stem, tokens
from attestry.operators.phrases import counted


def terms(text, stemmed: bool = True) -> Column:
    found = tokens(text)
    return F.transform(found, stem) if stemmed else found


#: A few questions at a time: (id, text).
Queries = list[tuple[int, str]]


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def _ranked(scored: DataFrame, k: int, chunk_id: str) -> DataFrame:
    """Scores above 0 of a column ``scores`` (query_id, score), best ``k`` a query."""
    rows = scored.select(chunk_id, F.inline("scores")).where("score > 0")
    return top_k(rows, "query_id", "score", chunk_id, k)


def tfidf(chunks: DataFrame, queries: Queries, k: int = 8, chunk_id: str = "chunk_id", title: str = "title", content: str = "content", keywords: str = "keywords") -> DataFrame:
    """The ``k`` best chunks of each query, of those that score.

    A query term weighs tf / max tf x (ln((N + 1) / (df + 1)) + 1), times the
    chunk's own tf / max tf; terms are stemmed, but df counts the chunks whose
    title or content has a word that *is* the stem, and a stem that is no word
    weighs 0.  2 for each keyword that the query contains, 1.5 for each query
    term (repeated ones too) in the title.

    Queries are few, so their terms are literals: the chunks are read twice, once
    for df and once to score, and no word is shuffled.
    """
    spark = chunks.sparkSession
    asked = spark.createDataFrame(queries, "query_id long, q string").select("query_id", F.lower("q").alias("q"), terms("q").alias("terms")).collect()
    words = sorted({t for r in asked for t in r.terms})
    if not words:
        return chunks.select(F.lit(0).cast("long").alias("query_id"), chunk_id, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    kw = F.coalesce(F.col(keywords), F.array().cast("array<string>"))
    texts = chunks.select(chunk_id, F.coalesce(title, F.lit("")).alias("_t"), F.coalesce(content, F.lit("")).alias("_c"), kw.alias("_k"))
    plain = texts.select(tokens(F.concat_ws(" ", "_t", "_c")).alias("w"))
    counts = plain.agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("w", t)).alias(f"d{i}") for i, t in enumerate(words)]).first()  # a count for each query term
    idf = {t: math.log((counts["n"] + 1) / (counts[f"d{i}"] + 1)) + 1 if counts[f"d{i}"] else 0.0 for i, t in enumerate(words)}
    def figures(stems: Column) -> Column:
        """Longest run of equal stems in sorted order, and the count of each query term."""
        start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(1).alias("top"))
        run = lambda acc, w: F.when(acc["last"] == w, acc["run"] + 1).otherwise(F.lit(1))
        most = F.aggregate(stems, start, lambda acc, w: F.struct(w.alias("last"), run(acc, w).alias("run"), F.greatest(acc["top"], run(acc, w)).alias("top")))["top"]
        some = F.filter(stems, lambda w: w.isin(*words))
        return F.struct(most.alias("top"), bound(some, lambda have: F.array(*[held(have, t) for t in words])).alias("n"))

    def held(stems: Column, term: str) -> Column:
        return F.size(F.filter(stems, lambda w: w == F.lit(term)))

    def named_in(question: str) -> Column:
        return F.size(F.filter("_k", lambda x: F.contains(F.lit(question), F.lower(x)))) * 2.0

    stems = F.sort_array(terms(F.concat_ws(" ", "_t", "_c", F.array_join("_k", " "))))
    stems = texts.select(chunk_id, "_k", bound(stems, figures).alias("_x"), terms("_t").alias("_ts"))
    scores = []
    for r in asked:
        most = max(map(r.terms.count, r.terms), default=1)
        tf = [F.col("_x")["n"][words.index(t)] / F.col("_x")["top"] * (r.terms.count(t) / most * idf[t]) for t in sorted(set(r.terms))]
        titled = [F.when(F.array_contains("_ts", t), 1.5).otherwise(0.0) for t in r.terms]
        scores.append(F.struct(F.lit(r.query_id).cast("long").alias("query_id"), half_up(_sum([*tf, named_in(r.q), *titled]), 6).alias("score")))
    return _ranked(stems.select(chunk_id, F.array(*scores).alias("scores")), k, chunk_id)


#: Latin letters with marks, and without.
MARKED, BARE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def plain_text(text) -> Column:
    """Lower case without marks; anything but a-z, digits, Arabic is one space."""
    s = F.regexp_replace(F.translate(F.lower(text), MARKED, BARE), r"\p{Mn}", "")
    return F.trim(F.regexp_replace(s, "[^a-z0-9\u0600-\u06FF]+", " "))


def top_k(scored: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keyword_scores(chunks: DataFrame, queries: Queries, k: int = 8, chunk_id: str = "chunk_id", title: str = "title", content: str = "content", keywords: str = "keywords") -> DataFrame:
    """The ``k`` best chunks of each query by its terms of two letters and more.

    A term gives 5 if a keyword contains it, 1 for each keyword that does, 2 (from
    three letters on) for each keyword of three letters and more that it begins or
    that begins it, and 1 for each of its first five places in keywords, title and
    content.  Scored in place, without a join or a shuffle of words.
    """
    spark = chunks.sparkSession
    asked = spark.createDataFrame(queries, "query_id long, q string").select("query_id", F.filter(F.split(plain_text("q"), " "), lambda t: F.length(t) > 1).alias("terms")).collect()
    kw = F.coalesce(F.col(keywords), F.array().cast("array<string>"))
    whole = F.concat_ws(" ", F.array_join(kw, " "), plain_text(F.coalesce(title, F.lit(""))), plain_text(F.coalesce(content, F.lit(""))))

    terms = list(dict.fromkeys(t for r in asked for t in r.terms))
    # All terms are looked for in one pass over the cleaned text.
    places = counted(whole, terms, 5) if terms else F.array().cast("array<bigint>")
    texts = chunks.select(chunk_id, kw.alias("_k"), places.alias("_n"))

    def points(term: str, at: int, words: Column, seen: Column) -> Column:
        within = F.size(F.filter(words, lambda x: F.contains(x, F.lit(term))))
        begun = F.size(F.filter(words, lambda x: (F.length(x) >= 3) & (F.startswith(F.lit(term), x) | F.startswith(x, F.lit(term))))) if len(term) >= 3 else F.lit(0)
        return bound(within, lambda n: F.when(n > 0, 5).otherwise(0) + n) + 2 * begun + seen[at]

    def all_scores(words: Column, seen: Column) -> Column:
        """Each distinct term is judged once, however many queries have it."""
        per = F.array(*[points(t, i, words, seen).cast("long") for i, t in enumerate(terms)]) if terms else F.array().cast("array<bigint>")
        total = lambda p, r: reduce(lambda a, b: a + b, [p[terms.index(t)] for t in r.terms], F.lit(0).cast("long"))
        return bound(per, lambda p: F.array(*[F.struct(F.lit(r.query_id).cast("long").alias("query_id"), total(p, r).alias("score")) for r in asked]))

    scores = bound(F.struct("_k", "_n"), lambda t: all_scores(t["_k"], t["_n"]))
    return _ranked(texts.select(chunk_id, scores.alias("scores")), k, chunk_id)


def intents(texts: DataFrame, key: str, text: str, keywords: list[tuple[str, str, float]]) -> DataFrame:
    """The intent with the largest sum of keyword weights; ties go to the one
    named first, no hit gives 'unknown'."""
    order: dict[str, int] = {}
    for intent, _, _ in keywords:
        order.setdefault(intent, len(order))
    s = F.lower(F.col(text))
    scores = []
    for intent, i in order.items():
        total = F.lit(0.0)
        for name, word, weight in keywords:
            if name == intent:
                total = total + F.when(F.contains(s, F.lit(word)), weight).otherwise(0.0)
        scores.append(F.struct(total.alias("score"), F.lit(-i).alias("order"), F.lit(intent).alias("intent")))
    best = F.array_max(F.array(*scores))
    return texts.select(key, F.when(best["score"] > 0, best["intent"]).otherwise("unknown").alias("intent"), F.coalesce(best["score"], F.lit(0.0)).alias("score"))


def with_context(turns: DataFrame, conversation: str, turn: str, text: str, back: int = 3) -> DataFrame:
    """Adds ``context``: the texts of the turns before, oldest first."""
    w = Window.partitionBy(conversation).orderBy(turn).rowsBetween(-back, -1)
    return turns.withColumn("context", F.array_join(F.collect_list(text).over(w), "\n"))


#: Query vectors that are sent to the tasks at a time.
QUERY_BLOCK = 8192
#: Queries by vectors that a task compares at once: 16 MB of similarities.
QUERY_TILE, VECTOR_TILE = 1024, 2048


def nearest_vectors(gallery: DataFrame, queries: DataFrame, k: int, id_column: str, vector: str, block: int = QUERY_BLOCK) -> DataFrame:
    """``query``, ``vec_id``, ``similarity`` (cosine, 6 places), ``rank``: the k
    most similar other vectors of the gallery; ties go to the smallest id.

    Queries go to the tasks in blocks of bounded size.  A task multiplies its
    batches by a block, tile by tile, and keeps k rows a query, so its memory has
    a bound and k rows a query and partition are shuffled.  All pairs are compared:
    the time is queries by vectors.  Null, zero and odd vectors and rows without an
    id are left out.
    """

    def tile(kept_id: np.ndarray, kept: np.ndarray, ids: np.ndarray, asked: np.ndarray, own: np.ndarray, values: np.ndarray) -> None:
        """Puts the better ones of a tile's vectors, which come in order of their ids, among the k kept for each query."""
        cos = asked @ values.T
        cos *= 1e6
        cos += 0.5
        np.floor(cos, out=cos)
        cos[~np.isfinite(cos)] = -np.inf
        cos[ids[:, None] == own] = -np.inf
        # A vector of equal similarity may have a smaller id.
        top = cos.max(axis=1)
        rows = np.flatnonzero((top >= kept[:, -1]) & (top > -np.inf))
        if not len(rows):
            return
        # Millionths and place in one whole number, so that of equal similarities those with the smallest ids are taken.
        n = len(own)
        keys = cos[rows] * n - np.arange(n)
        at = np.argpartition(keys, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), keys.shape)
        sims = np.concatenate([kept[rows], np.take_along_axis(cos[rows], at, 1)], axis=1)
        names = np.concatenate([kept_id[rows], own[at]], axis=1)
        order = np.lexsort((names, -sims), axis=1)[:, :k]
        kept[rows], kept_id[rows] = np.take_along_axis(sims, order, 1), np.take_along_axis(names, order, 1)

    spark = gallery.sparkSession
    flat = lambda df: df.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = flat(queries)
    n = asked.count()
    parts = max(1, -(-n // block))
    out = None
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect()  # about one block
        if not rows:
            continue
        ids, matrix = np.array([r.id for r in rows]), np.array([r.v for r in rows], np.float64)
        sent = spark.sparkContext.broadcast((ids, matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            kept_id, kept = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -np.inf)
            for batch in batches:
                own = batch.column("id").to_numpy()
                values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, matrix.shape[1])
                values = values / np.sqrt((values * values).sum(axis=1, keepdims=True))
                order = np.argsort(own, kind="stable")
                for j in range(0, len(own), VECTOR_TILE):
                    some = order[j : j + VECTOR_TILE]
                    for i in range(0, len(ids), QUERY_TILE):
                        q = slice(i, i + QUERY_TILE)
                        tile(kept_id[q], kept[q], ids[q], matrix[q], own[some], values[some])
            row, col = np.nonzero(np.isfinite(kept))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(kept_id[row, col]), pa.array(kept[row, col] / 1e6)], ["query", "vec_id", "similarity"])

        found = flat(gallery).where(F.size("v") == matrix.shape[1]).mapInArrow(best, "query long, vec_id long, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query long, vec_id long, similarity double")
    return top_k(out, "query", "similarity", "vec_id", k)
