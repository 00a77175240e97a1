import hashlib
import random
import re

import numpy as np
import pytest

from loadweave.llm import decontamination as deco
from loadweave.llm.fmindex import FMIndex, suffix_array
from tests.llm import edges

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def by_hand(docs, items, window=10):
    phrases = []
    for item, text in items:
        words = WORD.findall(lower(text))
        for i in range(max(1, len(words) - window + 1)) if words else ():
            phrases.append((item, words[i : i + window]))
    for doc_id, text in docs:
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for item, phrase in phrases:
            for i in range(len(words) - len(phrase) + 1):
                if words[i : i + len(phrase)] == phrase:
                    hit |= set(range(i, i + len(phrase)))
                    found |= {str(item)} if item is not None else set()
        listed = ",".join(sorted(found)).encode()
        yield doc_id, len(words), len(hit), len(found), hashlib.sha256(listed).hexdigest(), bool(hit)


@pytest.mark.parametrize("size", [0, 1, 2, 50, 400])
@pytest.mark.parametrize("symbols", [1, 2, 5])
def test_index_finds_all_occurrences(size, symbols):
    rng = random.Random(size * 10 + symbols)
    text = np.array([rng.randrange(symbols) for _ in range(size)], np.int64)
    assert suffix_array(text).tolist() == sorted(range(size), key=lambda i: text[i:].tolist())
    index = FMIndex(text)
    patterns = np.array([[rng.randrange(symbols + 1) for _ in range(3)] for _ in range(40)])
    found, low, high = index.search(patterns)
    places = {int(f): sorted(index.locate(np.arange(a, b)).tolist()) for f, a, b in zip(found, low, high, strict=True)}
    for k, p in enumerate(patterns.tolist()):
        expected = [i for i in range(size - 2) if text[i : i + 3].tolist() == p]
        assert places.get(k, []) == expected


ITEMS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (2, "Short ITEM only"),
    (2, "Short ITEM only"),
    (3, None),
    (4, ""),
    (None, "no id here at all"),
    (5, "É漢 é"),
]
DOCS = [
    (1, "x ALPHA beta, gamma delta epsilon zeta eta theta iota kappa lambda mu y"),
    (2, "beta gamma delta epsilon zeta eta theta iota kappa lambda nu"),
    (3, "short item only short item only. No id here at ALL!"),
    (3, None),
    (None, "short item only"),
    (4, ""),
    (5, "é漢 é É漢 é"),
    (6, "short item" * 2000),
    (7, "alpha beta gamma delta alpha beta gamma delta epsilon zeta eta theta iota kappa"),
]


@pytest.mark.parametrize("shard,block", [(1_000_000, 500_000), (5, 4)])
def test_leaks(spark, monkeypatch, shard, block):
    monkeypatch.setattr(deco, "SHARD_WORDS", shard)
    monkeypatch.setattr(deco, "BLOCK_WORDS", block)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = [tuple(r)[:6] for r in deco.leaks(docs, items).collect()]
    assert sorted(found, key=repr) == sorted(by_hand(DOCS, ITEMS), key=repr)


def test_odd_documents(spark):
    docs = edges.clashing(edges.documents(spark))
    items = spark.createDataFrame([(1, edges.TEXTS[0][1]), (2, "word " * 10)], "item_id long, text string")
    pairs = [(d, t) for d, t, *_ in edges.TEXTS]
    found = [tuple(r)[:6] for r in deco.leaks(docs, items).collect()]
    expected = by_hand(pairs, [(1, edges.TEXTS[0][1]), (2, "word " * 10)])
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_cut_texts_are_clean(spark):
    # cutting the inner item joins the two halves of another one
    nested = "one two three four five SHORT item ONLY six seven eight nine ten tail"
    items = [(2, "short item only"), (9, "one two three four five six seven eight nine ten")]
    docs = edges.clashing(edges.documents(spark, [(1, nested, "en", "a"), (2, "clean é", None, None), (3, None, None, None)]))
    frame = spark.createDataFrame(items, "item_id long, text string")
    cut = deco.without_leaks(docs, frame)
    assert cut.schema == docs.schema
    assert {r.doc_id: r.text for r in cut.collect()} == {1: " tail", 2: "clean é", 3: None}
    assert not any(r.contaminated for r in deco.leaks(cut, frame).collect())


def test_a_shard_of_changed_texts_is_searched_as_one(monkeypatch):
    # two blocks; every text is cut, some of them in a second round
    items = [(2, "short item only"), (9, "one two three four five six seven eight nine ten")]
    blocks = [deco._block([(str(i), deco.words_of(t))], 10) for i, t in items]
    nested = "one two three four five SHORT item ONLY six seven eight nine ten tail"
    texts = [nested if i % 2 else f"a{i} short item only b" for i in range(60)] + [None, "", "clean"]
    rounds = []

    def counted(docs, phrases, find=deco._find):
        rounds.append(len(docs))
        return find(docs, phrases)

    monkeypatch.setattr(deco, "_find", counted)
    found = deco._cleaned(texts, [deco.words_of(t) for t in texts], blocks)
    assert found == [" tail" if i % 2 else f"a{i}  b" for i in range(60)] + [None, "", "clean"]
    assert rounds == [63, 60, 30]


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert deco.leaks(edges.empty(spark), items).count() == 0
    found = deco.leaks(edges.documents(spark), items).collect()
    assert len(found) == len(edges.TEXTS) and not any(r.contaminated for r in found)
