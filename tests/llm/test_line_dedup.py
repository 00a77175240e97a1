import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loadweave.llm import line_dedup
from tests.llm import edges
from tests.helpers import plan

SPACE = " \t\n\v\f\r"


def by_hand(rows, least):
    sites, first = defaultdict(set), {}
    for doc_id, text, _, source in rows:
        for pos, line in enumerate((text or "").split("\n")) if text is not None else ():
            if line.strip(SPACE):
                if source is not None:
                    sites[line].add(source)
                place = (doc_id is None, doc_id or 0, pos)
                first[line] = min(first.get(line, place), place)
    for doc_id, text, _, _ in rows:
        if text is None:
            yield doc_id, None
            continue
        kept = [
            line
            for pos, line in enumerate(text.split("\n"))
            if not line.strip(SPACE)
            or len(sites[line]) < least
            or first[line] == (doc_id is None, doc_id or 0, pos)
        ]
        yield doc_id, "\n".join(kept)


def many_lines():
    """Lines on 1 to 40 sites, a long document among them."""
    rows = []
    for k in range(1, 41):
        rows += [(1000 + 50 * k + s, f"on {k} sites\nown {k} {s}", "en", f"s{s}") for s in range(k)]
    long = "\n".join(f"on {1 + i % 40} sites" for i in range(300))
    return [*rows, (1, long, "en", "s0"), (1, long, "en", "s0"), (None, long, "en", None)]


@pytest.mark.parametrize("least", [1, 2, 3, 5, 30])
@pytest.mark.parametrize("rows", [edges.TEXTS, many_lines()], ids=["odd", "many"])
def test_lines_that_stay(spark, rows, least):
    docs = edges.clashing(edges.documents(spark, rows))
    found = line_dedup.without_boilerplate(docs, min_sites=least)
    assert found.schema == docs.schema
    got = [(r.doc_id, r.text) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(by_hand(rows, least), key=repr)


def test_sketch_band_is_settled_exactly(spark):
    # thousands of sites, just below, at and above the threshold
    rows = spark.range(3003).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(
            "\n",
            F.lit("everywhere"),
            F.when(F.col("id") < 3000, F.lit("at")),
            F.when(F.col("id") < 2999, F.lit("below")),
        ).alias("text"),
        F.lit("en").alias("lang"),
        F.concat(F.lit("s"), "id").alias("source"),
    )
    found = line_dedup.without_boilerplate(rows, min_sites=3000)
    counts = {r.text: r["count"] for r in found.groupBy("text").count().collect()}
    assert counts == {"everywhere\nat\nbelow": 1, "below": 2998, "": 4}


def test_report_and_no_python(spark):
    report = line_dedup.line_report(edges.documents(spark), min_sites=3)
    assert report.count() == len(edges.TEXTS)
    assert "Python" not in plan(report) and "Arrow" not in plan(report)


def test_empty_table(spark):
    assert line_dedup.line_report(edges.empty(spark)).count() == 0


def test_very_many_lines_in_one_text(spark):
    # a line finds its mask at once, so no step takes the square of the lines; every second one goes
    n = 500_000
    text = "\n".join(f"line {i}" for i in range(n))
    mask = sum(1 << i for i in range(1, 64, 2)) - (1 << 64)
    df = spark.createDataFrame([(text, [mask] * (n // 64 + 1))], "text string, masks array<long>")
    start = time.perf_counter()
    left = df.select(line_dedup._remaining(F.col("text"), F.col("masks"))).first()[0]
    assert time.perf_counter() - start < 60
    assert left == "\n".join(f"line {i}" for i in range(0, n, 2))


def test_masks_between_which_nothing_goes(spark):
    # boilerplate in lines 0, 700 and 1300 only: whole masks are missing before, between and after
    shared = {0: "b a", 700: "b b", 1300: "b c"}
    text = "\n".join(shared.get(i, f"own {i}") for i in range(2000))
    rows = [(i, "\n".join(shared.values()), "en", f"s{i}") for i in range(5)]
    rows += [(7, text, "en", "s1"), (8, "\n" * 64 * 5 + "b b", "en", "s2")]
    found = {r.doc_id: r.text for r in line_dedup.without_boilerplate(edges.documents(spark, rows)).collect()}
    assert found == dict(by_hand(rows, 5))


def test_only_what_is_read_twice_is_written(spark, monkeypatch):
    written = []
    pin = line_dedup.pin
    monkeypatch.setattr(line_dedup, "pin", lambda df: written.append(df.columns) or pin(df))
    found = line_dedup.without_boilerplate(edges.documents(spark, many_lines()), min_sites=5)
    assert len(written) == 3 and not any("masks" in columns for columns in written)
    # both sides are shuffled right below the join: what adaptive execution needs to split a hot key
    join = plan(found).split("SortMergeJoin", 1)[1]
    assert len(re.findall(r"Exchange hashpartitioning\(key#\d+L, check#", join)) == 2
