"""A training-data pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import bpe, common, contamination, lines, quality, simhash
from lamina.session import delete, scratch


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Those that importance resampling toward labelled good text keeps."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that three documents or more share, but in the last of them."""
    return lines.without_lines(docs)


def one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than a twentieth of benchmark text."""
    return contamination.without_benchmark(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document that is left."""
    return bpe.digests(docs)


STAGES = [("quality classifier", good_documents), ("line dedup", fresh_lines), ("SimHash near-dedup", one_of_a_kind), ("benchmark decontamination", unseen), ("byte-level BPE", tokens)]

#: No stage's XXH64, n-gram model or BPE is expressible in DuckDB's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's documents are deleted when the next one's are written; the last ones stay, as the result reads them."""
    docs, folder, before = common.table(spark, sf_dir, "documents"), scratch(spark), ""
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if before:
                delete(spark, before)
            before = f"{folder}/{k}"
    return docs
