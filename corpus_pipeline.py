"""From raw documents to token ids: five stages, each over all that the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.llm import bpe, decontamination, line_dedup, quality_rules, similar
from loadweave.llm.common import table
from loadweave.session import pin


def _counted(docs: DataFrame) -> DataFrame:
    """Documents whose texts were cut, with the number of characters that are left."""
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a quality rule rejects."""
    return quality_rules.passing(docs, table(spark, sf_dir, "labels"))


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that many sources share, all but the first of each; drops no document."""
    return _counted(line_dedup.without_boilerplate(docs, site="source", min_sites=5))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates: 80 % of five-word shingles in common."""
    return similar.one_of_each(docs, words=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of ten words and more that the benchmark has; drops no document."""
    return _counted(decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The byte-level BPE ids of each document, decoded again as a check."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encoded(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", boilerplate),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("byte_bpe", token_ids),
]

# SQL can express neither fingerprints nor merges
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
