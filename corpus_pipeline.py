"""From documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm.common import documents, fresh_path, small_batches
from vecloom.llm.decontaminate import keep_clean
from vecloom.llm.near_dup import keep_one
from vecloom.llm.packing import pack_documents
from vecloom.llm.pii import redact
from vecloom.llm.quality_rules import keep_good
from vecloom.llm.tokens import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules reject, or that fail the base rules, go."""
    small_batches(spark)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or near-equal texts stays, that with the least doc_id."""
    small_batches(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    small_batches(spark)
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows."""
    small_batches(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as ids in sequences of at most 2048, a row per piece with its ids."""
    small_batches(spark)
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: Weights of rules, signatures, alignments, boosted trees and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written as Parquet in the shared folder and read again as the next one's documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        at = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
