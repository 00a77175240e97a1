import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tests.helpers import rows

from loadweave.functions.ordered import (
    RANGE,
    carry_forward,
    dense_ids,
    running_total,
    split_ranges,
)


def hot_rows(n=900, seed=1):
    """Two thirds of the rows in one group, many ties in the first sort column."""
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < 0.66 else rng.choice("abc"), rng.randint(0, 5), i, rng.randint(0, 9))
        for i in range(n)
    ]


@pytest.mark.parametrize("ranges", [None, 1, 7, 40])
def test_running_total_matches_a_loop(spark, ranges):
    data = hot_rows()
    df = spark.createDataFrame(data, "g string, t int, id long, v long")
    got = rows(running_total(df, ["g"], ["t", "id"], "v", "total", ranges), "id", "total")
    totals, expected = defaultdict(int), []
    for g, _, i, v in sorted(data):
        totals[g] += v
        expected.append((i, totals[g]))
    assert got == sorted(expected, key=repr)


@pytest.mark.parametrize("ranges", [None, 1, 7, 40])
def test_carry_forward_matches_a_loop(spark, ranges):
    rng = random.Random(3)
    data = [
        (g, t, i, rng.choice([None, None, None, v]), rng.choice([None] * 20 + [-v]))
        for g, t, i, v in hot_rows()
    ]
    df = spark.createDataFrame(data, "g string, t int, id long, v long, w long")
    got = rows(carry_forward(df, ["g"], ["t", "id"], ["v", "w"], ranges), "id", "v", "w")
    last_v, last_w, expected = {}, {}, []
    for g, _, i, v, w in sorted(data, key=lambda r: r[:3]):
        last_v[g] = v if v is not None else last_v.get(g)
        last_w[g] = w if w is not None else last_w.get(g)
        expected.append((i, last_v[g], last_w[g]))
    assert got == sorted(expected, key=repr)


def test_a_hot_group_is_spread_over_ranges(spark):
    df = spark.createDataFrame(hot_rows(4000), "g string, t int, id long, v long")
    sizes = [r["count"] for r in split_ranges(df, ["g", "t", "id"], 16).groupBy(RANGE).count().collect()]
    assert len(sizes) == 16
    assert max(sizes) < 3 * 4000 / 16


@pytest.mark.parametrize("ranges", [None, 1, 9])
def test_dense_ids_have_no_gaps_and_follow_the_order(spark, ranges):
    df = spark.range(0, 5000, 1, 13).select(F.xxhash64("id").alias("k"), "id")
    numbered = dense_ids(df.withColumnRenamed("id", "old"), ["k"], "id", 100, ranges).collect()
    assert [r["id"] for r in sorted(numbered, key=lambda r: r["k"])] == list(range(100, 5100))


def test_empty_input_stays_empty(spark):
    df = spark.createDataFrame([], "g string, t int, id long, v long")
    assert running_total(df, ["g"], ["t", "id"], "v", "total").count() == 0
    assert carry_forward(df, ["g"], ["t", "id"], ["v"]).count() == 0
    assert dense_ids(df.drop("id"), ["g", "t"]).count() == 0


def test_numbering_uses_no_window_over_the_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    numbered = dense_ids(df, ["k"])
    text = numbered._jdf.queryExecution().optimizedPlan().toString()
    window_input = text[text.index("Window") :].splitlines()[1]
    assert "Aggregate" in window_input
