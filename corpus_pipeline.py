"""A training corpus from ``documents``: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``.  Stages that look at several documents look
at all that their predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import cluster, decontaminate, jaccard_join, language_id, packing, substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Posterior that a language needs; below it a document is rejected.
SURE = 0.5

#: No SQL can express the classifier, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or of no sure
    language, go; the others stay as they are."""
    said = language_id.predict(docs, language_id.train(docs), carry=("lang", "source", "n_chars"), with_text=True)
    return said.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select("doc_id", "text", "carry.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8) the
    document with the smallest id stays.  Rows of one id stay or go together; a row
    without an id, and a text without words, links with nothing and stays."""
    groups = jaccard_join.join_groups(docs, k=5, percent=80)
    gone = groups.where("doc_id <> component_id").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that occur twice are cut from all texts.
    A text that loses nothing stays as it is; one that loses all goes."""
    out = substring_dedup.remove_repeats(docs, carry=("doc_id", "lang", "source", "n_chars"), tidy=False)
    out = out.where("n_removed = 0 or n_removed < n_words")
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("carry.n_chars"))
    return out.select("carry.doc_id", F.col("kept_text").alias("text"), "carry.lang", "carry.source", n_chars.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row with a benchmark item go.  Null,
    empty and very long texts are judged alike: without words there is no hit and
    the document stays.  Rows of one id stay or go together; a row without an id
    stays."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = decontaminate.find(docs, items).where("n_hit > 0").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as query op10 returns them.  A null or empty text
    is its end id alone; repeated rows are packed each for itself."""
    out = packing.pack(docs)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", remove_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    cluster.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cluster.written(stage(spark, docs, sf_dir), name)
    return docs
