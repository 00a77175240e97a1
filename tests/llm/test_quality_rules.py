import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loadweave.llm import quality_rules as rules
from tests.helpers import plan
from tests.llm import edges

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
        len(lines),
    )


TEXTS = [t for _, t, *_ in edges.TEXTS] + [
    "a b c a b c",
    "a b c d a b c",
    "a a a",
    "a a a a",
    "x y z\nx y z\n\n \nx y z",
    "# * $ | <b>&amp;</b> %",
    "a b c x b c y a b c x b c",
]


def test_counts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    found = docs.select("doc_id", rules.measured(F.col("text")).alias("m")).select("doc_id", "m.*")
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == {
        i: by_hand(t) for i, t in enumerate(TEXTS)
    }


def tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


@pytest.mark.parametrize("n,p", [(1, 0.5), (10, 0.3), (300, 0.02), (900, 0.01)])
def test_binomial_tail(spark, n, p):
    rows = spark.range(n + 1).select("id", rules._log_tail(F.col("id"), F.lit(n).cast("long"), p).alias("p"))
    for r in rows.collect():
        expected = tail(r.id, n, p) if r.id < n * p else 1.0
        assert r.p == pytest.approx(expected, rel=1e-9, abs=1e-300)


def test_tail_of_many_rows(spark):
    # (1 - p)**n is far below the smallest double here
    p = spark.range(1).select(rules._log_tail(F.lit(9700).cast("long"), F.lit(1_000_000).cast("long"), 0.01)).first()[0]
    assert 0 < p < 0.01


def labelled(spark, good, bad_share):
    """Clean texts of unlike words, a share of the labelled good ones with symbols."""
    rows, labels = [], []
    for i in range(good):
        words = [f"w{i}x{k}" for k in range(60)]
        if i < good * bad_share:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, 1, 0))
    rows.append((90001, " ".join(f"j{k}###" for k in range(60)), "en", "a"))
    rows.append((90002, " ".join(f"j{k}###" for k in range(60)), "xx", "a"))
    return edges.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("share,rejected", [(0.0, True), (0.3, False)])
def test_cutoffs_follow_the_labels(spark, share, rejected):
    docs, labels = labelled(spark, 1500, share)
    kept = {r.doc_id: r.kept for r in rules.verdicts(docs, labels).collect()}
    # where good documents have symbols too, symbols reject none; without labels, nothing does
    assert kept[90001] is not rejected and kept[90002]
    assert sum(not k for i, k in kept.items() if i < 90000) <= 0.01 * 1500


def test_few_labels_reject_nothing(spark):
    docs, labels = labelled(spark, 40, 0.0)
    assert all(r.kept for r in rules.verdicts(docs, labels).collect())


def test_rows_that_pass(spark):
    docs = edges.clashing(edges.documents(spark, [*edges.TEXTS, (50, " ".join(map(str, range(60))), None, None)]))
    labels = spark.createDataFrame([(50, 1, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    found = rules.passing(docs, labels)
    assert found.columns == docs.columns
    assert [r.doc_id for r in found.collect()] == [50]
    report = rules.verdicts(docs, labels)
    assert {(r.doc_id, r.kept) for r in report.collect()} == {(d, d == 50) for d, *_ in [*edges.TEXTS, (50,)]}
    assert "Python" not in plan(report) and "Arrow" not in plan(report)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rules.verdicts(edges.empty(spark), labels).count() == 0
    assert rules.verdicts(edges.documents(spark), labels).count() == len(edges.TEXTS)
