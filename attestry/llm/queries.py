"""The registered queries: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.llm import chat_format, cluster, decontaminate, embedding_dedup, jaccard_join, language_id, license_scan, oracles, packing, prefix_trie, resampling, substring_dedup, token_counts, toxicity, wavelet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    cluster.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    rows = rows.unionByName(own)
    # Linear trees: each row answers the one before it.
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = rows.withColumn("msg", place).withColumn("tree", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    rows = rows.select("tree", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    out = chat_format.formatted(chat_format.ranked(rows))
    turns = chat_format.parsed(F.col("formatted"))
    loss = chat_format.loss_text(F.col("formatted"), F.col("loss"))
    out = out.select(F.expr("try_cast(tree as bigint)").alias("conv_id"), F.col("formatted"), turns.alias("t"), loss.alias("l"), "loss")
    return out.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("l").cast("long").alias("loss_chars"),
        F.sha2(F.col("l").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = language_id.predict(docs, language_id.train(docs))
    return said.select("doc_id", language_id.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("carry.doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_groups(table(spark, sf_dir, "documents"), k=3, percent=90)


def op6_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = cluster.fresh_path(spark, "wavelet")
    wavelet.write(table(spark, sf_dir, "documents"), folder)
    return wavelet.read(spark, folder)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_groups(table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prefix_trie.turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.nodes(prefix_trie.occurrences(prefix_trie.regrouped(rows, group=5, spread=9), ("base", "conv")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(language_id.is_held_out(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, min_words=20, seed=7)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_chat_formatting,
            op2_language_id,
            op3_substring_dedup,
            op4_token_counts,
            op5_ngram_jaccard_join,
            op6_token_id_output,
            op7_benchmark_decontamination,
            op8_embedding_near_dedup,
            op9_license_scan,
            op10_packing,
            op11_conversation_prefix_trie,
            op12_toxicity,
            op13_importance_resampling,
        )
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
