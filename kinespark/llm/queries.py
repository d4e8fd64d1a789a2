"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinespark.llm import bpe, conversations, fingerprints, katz, language_id, line_dedup, merkle, mixing, packing, simhash, topk, toxicity, training_order


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.digest(_table(spark, sf_dir, "documents"), bpe.vocabulary_path("byte_bpe_50k.tiktoken"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), bpe.vocabulary_path())


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.vectors(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows.filter("vec_id % 50 = 0"), rows)


def op9_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_edits(_table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_language_id, op2_document_fingerprints, op3_mix_sources, op4_toxicity_chain, op5_training_order,
        op6_simhash_near_dedup, op7_bpe_round_trip, op8_exact_top_k, op9_katz_scores, op10_line_dedup,
        op11_merkle_manifest, op12_conversation_trie, op13_pack_sequences,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": mixing.SQL, "op8_exact_top_k": topk.SQL, "op11_merkle_manifest": merkle.SQL, "op12_conversation_trie": conversations.SQL}
