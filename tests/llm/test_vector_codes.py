"""Codes of vectors against plain assignment and means in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from loadweave.llm import vector_codes

SCHEMA = "vec_id long, label int, embedding array<float>"


def by_hand(rows, parts=8, codes=16, rounds=6):
    """rows: (vec_id, label, vector); the result rows in any order."""
    kept = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = []
    for _, _, v in kept:
        v = [math.floor(4096 * float(x)) for x in v]
        size = len(v) // parts
        cut.append([v[p * size : (p + 1) * size] for p in range(parts)])
    books = [[c[p] for c in cut[:codes]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(p, c[p])[1], []).append(c[p])
            for k, found in groups.items():
                books[p][k] = [sum(x) // len(found) for x in zip(*found, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded, labels = [], {}
    for (vec_id, label, _), c in zip(kept, cut, strict=True):
        found = [near(p, c[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        labels[label] = labels.get(label, 0) + error
        coded.append((vec_id, label, "".join(f"{k:02x}" for _, k in found), error))
    return sorted(((i, code, e, labels[lab], digest) for i, lab, code, e in coded), key=repr)


def vectors(n, length=16, seed=0, spread=0.2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(length)] for _ in range(5)]
    out = []
    for i in range(n):
        c = centres[min(rng.randrange(8), 4)]
        label = rng.choice([None, 0, 1, 1, 1])
        out.append((i, label, [float(np.float32(x + rng.gauss(0, spread))) for x in c]))
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in vector_codes.vector_codes(df, **options).collect()), key=repr)


def test_against_plain_rounds(spark):
    rows = vectors(300)
    assert found(spark, rows) == by_hand(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = vectors(30, 8, seed=1)
    rows += rows[:5] + [(None, None, rows[3][2]), (7, 2, None), (8, 2, [1.0] * 7 + [None])]
    rows += [(9, 2, [1.0] * 7 + [float("nan")]), (10, 2, [float("-inf")] + [0.0] * 7)]
    rows += [(i, 3, [0.5, -0.5, 0.0, -0.0, 1e-9, -1e-9, 0.25, 0.75]) for i in (-4, -3, -3, 50)]
    random.Random(3).shuffle(rows)
    expected = by_hand(rows)
    assert found(spark, rows) == expected
    assert len(expected) == len(rows) - 4


def test_few_rows_and_none(spark):
    rows = vectors(3, 8, seed=4)
    assert found(spark, rows) == by_hand(rows)
    assert found(spark, [(1, 1, None)]) == []
    assert found(spark, []) == []
    assert found(spark, [(1, None, [])]) == by_hand([(1, None, [])])


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = vectors(40, 8, seed=5)
    names = "v d code error part entry at total _label label_error".split()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"my {c}") for c in names})
    got = vector_codes.vector_codes(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(rows)


@pytest.mark.parametrize(
    "rows", [[(1, 1, [0.0] * 8), (2, 1, [0.0] * 16)], [(1, 1, [0.0] * 12)], [(1, 1, [1e30] * 8)]]
)
def test_vectors_that_have_no_code(spark, rows):
    with pytest.raises(ValueError):
        vector_codes.vector_codes(spark.createDataFrame(rows, SCHEMA))


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    centres = rng.integers(-3000, 3000, (16, 8))
    parts = centres[rng.integers(0, 16, 5000)] + rng.integers(-40, 40, (5000, 8))
    pivots = vector_codes.far_apart(centres, 4)
    to = np.sqrt(vector_codes._squares(parts, pivots)).astype(np.float32)
    code, best, made = vector_codes.nearest(parts, to, centres, pivots)
    squares = vector_codes._squares(parts, centres)
    assert (code == squares.argmin(axis=1)).all() and (best == squares.min(axis=1)).all()
    assert made < 0.2 * squares.size


@pytest.mark.parametrize("size", [2, 1 << 20])
def test_bounds_at_ties_and_large_values(size):
    # whole numbers where roots round: ties go to the lower index, pivots themselves are entries
    rng = np.random.default_rng(size)
    entries = rng.integers(-size, size + 1, (16, 4))
    entries[9] = entries[2]
    parts = np.concatenate([entries, rng.integers(-size, size + 1, (3000, 4))])
    pivots = vector_codes.far_apart(entries, 4)
    to = np.sqrt(vector_codes._squares(parts, pivots)).astype(np.float32)
    code, best, _ = vector_codes.nearest(parts, to, entries, pivots)
    squares = vector_codes._squares(parts, entries)
    assert (code == squares.argmin(axis=1)).all() and (best == squares.min(axis=1)).all()
