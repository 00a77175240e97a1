"""The registered queries of the corpus operators, each over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.llm import (
    bpe,
    decontamination,
    divergence,
    line_dedup,
    lm_scoring,
    minhash,
    quality_rules,
    secrets,
    sharding,
    simhash,
    token_files,
    vector_codes,
    warc,
)
from loadweave.llm.common import table

_QUERIES = {}


def _register(query):
    _QUERIES[query.__name__] = query
    return query


def all_queries() -> dict:
    return dict(_QUERIES)


@_register
def op1_decontamination(spark, sf_dir) -> DataFrame:
    docs, benchmark = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontamination.leaks(docs, benchmark, window=10)


@_register
def op2_secret_scan(spark, sf_dir) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


@_register
def op3_simhash(spark, sf_dir) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


@_register
def op4_line_dedup(spark, sf_dir) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"), "source", min_sites=5)


@_register
def op5_token_files(spark, sf_dir) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return token_files.read_documents(
        token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer)
    )


@_register
def op6_quality_rules(spark, sf_dir) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality_rules.verdicts(docs, labels)


@_register
def op7_sharding(spark, sf_dir) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


@_register
def op8_byte_bpe(spark, sf_dir) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    return bpe.encoded(docs, ranks, public_tokenizers.PATTERN, with_ids=False)


@_register
def op9_lm_scoring(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scoring.scores(docs, lm_scoring.train(docs))


@_register
def op10_warc(spark, sf_dir) -> DataFrame:
    return warc.read_bundles(warc.write_bundles(table(spark, sf_dir, "pages")))


@_register
def op11_minhash(spark, sf_dir) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"), words=2, percent=80)


@_register
def op12_vector_codes(spark, sf_dir) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"), parts=8, codes=16, rounds=6)


@_register
def op13_divergence(spark, sf_dir) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"), least_docs=3, top=200)
