"""Corpus preparation in five stages, each over what the one before it kept.

A stage takes (spark, docs, folder of the tables) and returns a DataFrame that
is written and read again as the next stage's documents. All but the last keep
the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from incidentkit.llm import byte_bpe, decontaminate, quality, secret_ledger, simhash
from incidentkit.llm.common import table
from incidentkit.llm.queries import QUALITY_CUT
from incidentkit.session import scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least QUALITY_CUT."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")), QUALITY_CUT)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (fingerprints of four-word shingles linked at four bits), the one with the smallest id."""
    return simhash.keep_one(docs)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    return secret_ledger.redact(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document left."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", keep_quality), ("near_duplicates", keep_distinct), ("decontamination", keep_unleaked), ("secrets", hide_secrets), ("byte_bpe", encode_texts)]
#: SQL can express neither the classifier nor the walks; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
