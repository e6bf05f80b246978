"""License scans by diagonal voting.

All word k-grams of all texts are hashed (rolling, Rabin-Karp).  Those that
occur in a template are joined in Spark to the places where they stand in it;
an occurrence of a template puts its k-grams on one diagonal, document place
less template place.  Votes are added up by diagonal.  A template of kind
``exact`` is found where a diagonal has all its k-grams.  For longer texts
neighbouring diagonals (a few words put in or left out) merge into overlapping
bands.  A band's span is verified against the template word for word: of the
k-grams that vote in it, those count that stand in the template's order, each
template place once.  Their share of the template's k-grams must be ``SHARE``.

The template table is part of this module, so its size is fixed, and it is
broadcast.  A k-gram that no template has can't vote and is left out before the
join.  Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
lower-cased; a null or empty text has none and gets no label.  Repeated rows
are scanned each for itself; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm import cluster, worker
from attestry.llm.text import ALNUM, Block, Words, blocks, windows

#: Phrase, label: found only as they stand.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: Sentences and whole texts of well-known licenses, label: found with small changes.
TEXTS = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-notice"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution", "creative-commons"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "as-is"),
    # Whole texts.
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit-full",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc-full",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd-2-full",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "zlib",
    ),
)

GRAM_PHRASE, GRAM_TEXT = 2, 3
#: Share of a text's k-grams that a span must have in order.
SHARE = 0.6


def _hashes(text: str, k: int) -> np.ndarray:
    block = Block(pa.RecordBatch.from_arrays([pa.array([text])], ["text"]), "text")
    words = Words(block, ALNUM, lower=True)
    return windows(words, words.hashes(), k)[1]


@lru_cache(1)
def templates() -> list[tuple[int, int, int, int, str, bool, int]]:
    """(k, hash, template, place, label, exact, number of k-grams)."""
    out = []
    for number, (text, label) in enumerate((*PHRASES, *TEXTS)):
        exact = number < len(PHRASES)
        k = GRAM_PHRASE if exact else GRAM_TEXT
        found = _hashes(text, k)
        out += [(k, int(h.astype(np.int64)), number, i, label, exact, len(found)) for i, h in enumerate(found)]
    return out


def drift(grams: Column) -> Column:
    """Words put in and left out, less each other, that an occurrence may have at
    any place; half of a band of diagonals."""
    return F.greatest(F.lit(8), F.floor(grams / 4))


def chain(spots: str) -> Column:
    """k-grams of the template that stand in its own order in the span: the
    longest run of spots that grows in place and in template place at once.

    Keeps the smallest template place that ends a run of each length."""

    def put(ends: Column, s: Column) -> Column:
        at = -s["back"]
        n = F.size(F.filter(ends, lambda e: e < at))
        return F.concat(F.slice(ends, 1, n), F.array(at), F.slice(ends, n + 2, F.greatest(F.size(ends) - n - 1, F.lit(0))))

    return F.size(F.aggregate(F.array_sort(spots), F.array().cast("array<int>"), put))


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: ``doc_id``, ``n_words``, ``n_base`` (places of
    phrases), ``first_word``, ``last_word`` (their smallest and largest start),
    ``base_labels`` and ``labels`` (comma-joined) and ``score``, the largest
    share of a template found."""
    spark = docs.sparkSession
    cluster.prepare(spark)
    # Rows are named by partition and place below, so a partition made anew must hold the same rows.
    flat = cluster.settled(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")))
    kind = flat.schema["doc_id"].dataType.simpleString()
    grams = {k: np.unique(np.array([h for kk, h, *_ in templates() if kk == k], np.int64)) for k in (GRAM_PHRASE, GRAM_TEXT)}

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for block in blocks(batch, "text"):
                words = Words(block, ALNUM, lower=True)
                hashes = words.hashes()
                at, gram = [], []
                for k, have in grams.items():
                    place, rolled = windows(words, hashes, k)
                    rolled = rolled.view(np.int64)
                    hit = have[np.minimum(np.searchsorted(have, rolled), len(have) - 1)] == rolled
                    at.append(place[hit])
                    gram.append(rolled[hit])
                at, gram = np.concatenate(at), np.concatenate(gram)
                order = np.argsort(at, kind="stable")
                at, gram = at[order], gram[order]
                bounds = np.searchsorted(at, words.first)
                place = at - np.repeat(words.first[:-1], np.diff(bounds))
                hits = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([pa.array(gram), pa.array(place)], ["gram", "place"]))
                yield pa.RecordBatch.from_arrays([pa.array(uid + np.arange(len(block))), block.rows.column("doc_id"), pa.array(words.counts), hits], ["uid", "doc_id", "n_words", "hits"])
                uid += len(block)

    rows = flat.mapInArrow(worker.tended("license", votes), f"uid long, doc_id {kind}, n_words long, hits array<struct<gram:bigint,place:bigint>>")
    rows = rows.select("uid", "doc_id", "n_words", F.explode_outer("hits").alias("hit")).select("uid", "doc_id", "n_words", "hit.gram", "hit.place")
    table = F.broadcast(spark.createDataFrame([t[1:] for t in templates()], "gram long, template int, at int, label string, exact boolean, grams int"))
    by = ["uid", "doc_id", "n_words", "template", "label", "exact", "grams"]
    # Votes by diagonal; a place of the template votes once on each.
    lines = rows.join(table, "gram", "left").groupBy(*by, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.array_sort(F.collect_set("at")).alias("ats"))
    # Neighbouring diagonals of a text merge in overlapping bands: each diagonal is
    # in two, so any occurrence that drifts by no more than a band's half is whole in one.
    half = F.floor(F.col("diagonal") / drift(F.col("grams")))
    bands = lines.withColumn("band", F.explode(F.when(F.coalesce("exact", F.lit(True)), F.array("diagonal")).otherwise(F.array(half - 1, half))))
    spots = F.flatten(F.collect_list(F.transform("ats", lambda at: F.struct((F.col("diagonal") + at).alias("place"), (-at).alias("back")))))
    bands = bands.groupBy(*by, "band").agg(spots.alias("spots"))
    distinct = F.size(F.array_distinct(F.transform("spots", lambda s: s["back"])))
    found = bands.withColumn("share", F.when(F.col("exact"), F.when(distinct == F.col("grams"), 1.0)).when(distinct >= SHARE * F.col("grams"), chain("spots") / F.col("grams")))
    base = F.col("exact") & F.col("share").isNotNull()
    more = ~F.col("exact") & (F.col("share") >= SHARE)
    labels = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return (
        found.groupBy("uid", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("band"))).alias("first_word"),
            F.max(F.when(base, F.col("band"))).alias("last_word"),
            labels(base).alias("base_labels"),
            labels(base | more).alias("labels"),
            F.coalesce(F.max(F.when(base | more, F.col("share"))), F.lit(0.0)).alias("score"),
        )
        .drop("uid")
    )
