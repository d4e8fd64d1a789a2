"""The corpus pipeline: STAGES in order, each reading what the one before wrote.

All stages but the last give rows of the table documents. A stage works on every row that it gets and passes rows on as
they are but for its own decision: toxic documents go; repeated passages are cut from later documents; of each group of
copies and near copies the document with the smallest id stays; each source is taken as often as its target says (rows may come
more than once); every text is encoded and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinespark.llm import bpe, line_dedup, mixing, near_copies, toxicity
from kinespark.llm.common import materialise


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier chain learns from the labels of these documents; those it finds toxic go."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned blocks of 50 words or more are cut from the later document."""
    return line_dedup.deduplicated(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: SimHash links, and five-word shingles of similarity 0.8 or more."""
    return near_copies.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1 in turn; at most three epochs of each."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row that is left."""
    return bpe.round_trip(docs, bpe.vocabulary_path())


STAGES = [("toxicity", reject_toxic), ("line dedup", dedup_lines), ("near-dedup", dedup_near), ("mixing", mix_sources), ("bpe", encode)]
#: Classifiers, alignments and merges are beyond SQL; a test holds run()'s rows against plain versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
