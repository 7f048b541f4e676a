"""The numbered queries: each applies its operator to a whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import block_mix, byte_bpe, decontaminate, exact_dedup, hilbert_shard, importance_draw, labelled, license_scan, ngram_join, quality_fm, suffix_dedup, token_align, toxicity_gru, wordpiece_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def scored(scores: DataFrame, at: float) -> DataFrame:
    return scores.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(quality_fm.quality_scores(docs, quality_fm.quality_model(docs, table(spark, sf_dir, "labels"))), 0.3)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"), digests=True)


def op4_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(toxicity_gru.toxicity_scores(docs, toxicity_gru.toxicity_model(docs, table(spark, sf_dir, "labels"))), 0.5)


def op5_hilbert_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shard.hilbert_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True, spaces=True)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join("items", ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated", "n_near")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(table(spark, sf_dir, "documents")).drop("text_key")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.license_scan(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")}).drop("blocks")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_mix.taken_words(block_mix.mix(table(spark, sf_dir, "documents")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_align.token_alignment(table(spark, sf_dir, "documents"), *paths, digests=True).withColumnRenamed("groups", "groups_sha256")


def op13_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_draw.importance_draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_exact_dedup,
            op2_quality_fm,
            op3_suffix_dedup,
            op4_toxicity_gru,
            op5_hilbert_shard,
            op6_byte_bpe,
            op7_token_counts,
            op8_decontaminate,
            op9_ngram_join,
            op10_license_scan,
            op11_source_mix,
            op12_token_alignment,
            op13_importance_draw,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.OP1_SQL, "op8_decontaminate": decontaminate.OP8_SQL, "op10_license_scan": license_scan.OP10_SQL, "op11_source_mix": block_mix.OP11_SQL}
