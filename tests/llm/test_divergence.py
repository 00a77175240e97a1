"""Divergences of sources against plain counting in whole numbers."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loadweave.llm import divergence
from tests.llm import edges

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def by_hand(rows, least_docs=3, top=200):
    """rows: (text, lang, source); the result as a set of tuples."""
    docs, counts = {}, {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(UPPER))
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(words)
        docs.setdefault(lang, Counter()).update(set(words))
    out = set()
    for lang, groups in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        whole = shares(sum(groups.values(), Counter()))
        own = {s: shares(c) for s, c in groups.items()}
        for a in groups:
            pairs = [
                (sum((own[a][t] - own[b][t]) ** 2 // own[b][t] for t in kept), b) for b in groups if b != a
            ]
            terms = [
                ((own[a][t] - whole[t]) ** 2 // whole[t], t)
                for t in kept
                if groups[a][t] and own[a][t] > whole[t]
            ]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(found, 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, a, part, item, value, rank))
    return out


def found(spark, rows, **options):
    docs = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string"
    )
    got = divergence.divergences(docs.repartition(5), **options).collect()
    assert len(set(got)) == len(got)
    return {tuple(r) for r in got}


def corpus(n, sources, seed=1):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}{chr(97 + i // 26)}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [
        (
            " ".join(rng.choices(words, weights, k=rng.randint(0, 80))),
            rng.choice(["en", "de", None]),
            # one source owns a third of all rows
            f"s{0 if rng.random() < 0.3 else rng.randrange(sources)}",
        )
        for _ in range(n)
    ]


def test_against_counting(spark):
    rows = corpus(400, 12)
    assert found(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("limits", [(50, 1 << 30, 1 << 20), (1 << 30, 200, 40)])
def test_small_bounds_change_nothing(monkeypatch, limits):
    # many spills, stripes of few terms at a time, little held
    entries, held, chunk = limits
    rows = corpus(200, 30, seed=2)
    monkeypatch.setattr(divergence, "_ENTRIES", entries)
    monkeypatch.setattr(divergence, "_BYTES", held)
    monkeypatch.setattr(divergence, "_CHUNK", chunk)
    docs = [(lang or "", source, text) for text, lang, source in rows]
    batch = pa.record_batch(
        [pa.array(x) for x in zip(*docs, strict=True)], names=["lang", "source", "text"]
    )
    spilled = pa.Table.from_batches(list(divergence._folded([batch])))
    keys = zip(*[spilled.column(c).to_pylist() for c in ("lang", "term")], strict=True)
    assert len(spilled) > 1.5 * len(set(keys))
    ordered = spilled.sort_by([("lang", "ascending"), ("term", "ascending")])
    merged = pa.Table.from_batches(list(divergence._merging(3)(ordered.to_batches(max_chunksize=3))))
    counts = Counter()
    docs_of = Counter()
    for lang, source, text in docs:
        words = TERM.findall(text.translate(UPPER))
        counts.update((lang, w, source) for w in words)
        docs_of.update({(lang, w) for w in words})
    got = {}
    for r in merged.to_pylist():
        term = r["term"].decode()
        assert r["docs"] == docs_of[r["lang"], term] >= 3
        got |= {(r["lang"], term, s): n for s, n in zip(r["sources"], r["counts"], strict=True)}
    assert got == {k: n for k, n in counts.items() if docs_of[k[:2]] >= 3}


def test_small_cells_change_nothing(monkeypatch, tmp_path):
    # what a task holds of pairs and terms is given out in parts; the sums are the same
    terms = [(f"t{i}".encode(), [f"s{j}" for j in range(9) if (i * 7 + j) % 3], i) for i in range(60)]
    table = pa.table(
        [
            pa.array(["en"] * 60),
            pa.array([t for t, _, _ in terms]),
            pa.array([3] * 60),
            pa.array([s for _, s, _ in terms]),
            pa.array([[i + len(x) for x in s] for _, s, i in terms]),
        ],
        schema=divergence._STRIPE,
    )
    n = Counter()
    for _, s, i in terms:
        n.update({x: i + len(x) for x in s})
    names = sorted(n)
    (tmp_path / "groups").mkdir()
    pq.write_table(
        pa.table({"lang": ["en"] * 9, "source": names, "n": [n[s] for s in names], "v": [60] * 9}),
        tmp_path / "groups" / "x.parquet",
    )

    def sums(step):
        out = Counter()
        for b in divergence._diverging(str(tmp_path / "groups"), 5)(table.to_batches(max_chunksize=step)):
            for r in b.to_pylist():
                out[r["source"], r["part"], r["item"]] += r["value"]
        return out

    expected = sums(60)
    assert len([k for k in expected if k[1] == "term"]) <= 45
    monkeypatch.setattr(divergence, "_CELLS", 20)
    monkeypatch.setattr(divergence, "_ROWS_OUT", 3)
    assert sums(7) == expected


def test_shares_are_exact():
    rng = random.Random(5)
    for _ in range(200):
        total = rng.randint(1, (1 << 63) // 1000 - 1)
        count = rng.randint(0, total - 1)
        got = divergence._share(np.array([count]), np.array([total]))[0]
        assert int(got) == 1 + 10**9 * (count + 1) // total


def test_odd_documents(spark):
    docs = edges.clashing(edges.documents(spark))
    rows = [(t, lang, source) for _, t, lang, source in edges.TEXTS]
    got = divergence.divergences(docs, least_docs=1)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == by_hand(rows, 1)
    assert {tuple(r) for r in divergence.divergences(docs, top=3).collect()} == by_hand(rows, 3, 3)
    assert divergence.divergences(edges.empty(spark)).count() == 0


def test_groups_without_terms_and_long_texts(spark):
    rows = [("", "xx", "a"), (None, "xx", "b"), ("1 2 3", "xx", None), ("alone", "yy", "a")]
    assert found(spark, rows) == by_hand(rows)
    assert len(found(spark, rows)) == 6
    long = "lang Wort " * 400_000 + "é" * 100_000
    rows = [(long, "de", "a"), (long, "de", "b"), ("wort wort é", "de", "b"), ("lang", "de", "c")]
    assert found(spark, rows, least_docs=2) == by_hand(rows, 2)


def test_ties_go_by_bytes(spark):
    # equal values everywhere: the order is that of UTF-8
    rows = [("b a é ｚ \U0001f600", "en", "x")] * 3 + [("c", "en", "y")] * 3
    assert found(spark, rows, top=3) == by_hand(rows, 3, 3)
