"""The quality stage of the pipeline where the labels are enough for a cutoff."""

import math

import pytest

import corpus_pipeline
from loadweave.llm import quality_rules as rules
from tests.llm.test_quality_rules import labelled


def rejected(spark, folder, good, share):
    docs, labels = labelled(spark, good, share)
    labels.write.parquet(f"{folder}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, str(folder)).collect()}
    return {r.doc_id for r in docs.select("doc_id").collect()} - kept


@pytest.mark.parametrize("good,enough", [(299, True), (298, False)])
def test_whole_risk_for_one_sequence(spark, tmp_path, good, enough):
    # one stratum: (1 - 0.01) ** good is at most 0.05 from 299 on
    assert (0.99**good <= 0.05) is enough
    assert rejected(spark, tmp_path, good, 0.0) == ({90001} if enough else set())


def test_good_documents_with_symbols(spark, tmp_path):
    # 30 % of the good ones have them, so no setting that rejects them is safe
    assert rejected(spark, tmp_path, 500, 0.3) == set()


def test_rules_count_together(spark):
    # 4 of 1000 break each rule: each alone is under the risk, all three are not
    part = 4
    rows = [(i, "en", (100, 0, 0, 0, 0, 10)) for i in range(1000)]
    for k in range(part):
        rows[k] = (k, "en", (100, 0, 30, 0, 0, 10))
        rows[part + k] = (part + k, "en", (100, 0, 0, 3, 0, 10))
        rows[2 * part + k] = (2 * part + k, "en", (100, 0, 0, 0, 30, 10))
    kind = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    measures = spark.createDataFrame(
        rows, "doc_id long, stratum string, m struct<" + kind.replace(" long", ":long") + ">"
    )
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1000)], "doc_id long, quality int, toxic int")
    tail = sum(math.comb(1000, i) * 0.01**i * 0.99 ** (1000 - i) for i in range(part + 1))
    assert tail <= 0.05
    found = rules.joint_thresholds(measures, labels).collect()
    # 300 promille is not above 300, so that is the lowest setting without a rejection
    assert [tuple(r) for r in found] == [("en", 1000, 300, 300, 300)]
