import math
import random
import zlib
from collections import Counter

import pytest

from loadweave.llm import lm_scoring as lm
from tests.llm import edges


def tokens(text):
    return [*(text or "").encode().lower().split(), b"</s>"]


def discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    if not all(n):
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    found = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
    return tuple(min(max(d, 0), k) for k, d in enumerate(found, 1))


class ByHand:
    def __init__(self, rows):
        learnt = [tokens(t) for d, t, *_ in rows if d is not None and zlib.crc32(str(d).encode()) % 10]
        self.words = Counter(w for t in learnt for w in t)
        self.pairs = Counter(p for t in learnt for p in zip([None, *t], t, strict=False))
        self.follows = Counter(v for _, v in self.pairs)
        self.high, self.low = discounts(list(self.pairs.values())), discounts(list(self.follows.values()))
        self.total, self.left = Counter(), Counter()
        for (u, _), c in self.pairs.items():
            self.total[u] += c
            self.left[u] += self.high[min(c, 3) - 1]

    def p(self, u, v):
        n, kinds = len(self.words), len(self.pairs)
        low = 1 / (n + 1)
        if kinds:
            low *= sum(self.low[min(c, 3) - 1] for c in self.follows.values()) / kinds
            if c := self.follows[v]:
                low += max(c - self.low[min(c, 3) - 1], 0) / kinds
        if not self.total[u]:
            return low
        c = self.pairs[u, v]
        high = max(c - self.high[min(c, 3) - 1], 0) if c else 0
        return high / self.total[u] + self.left[u] / self.total[u] * low

    def row(self, doc_id, text):
        found, all_ = tokens(text), sum(self.words.values())
        held = doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0
        base = sum(math.log10((self.words[w] + 0.1) / (all_ + 0.1 * (len(self.words) + 1))) for w in found)
        score = sum(math.log10(self.p(u, v)) for u, v in zip([None, *found], found, strict=False))
        return doc_id, held, len(found), sum(w in self.words for w in found), all_, base, score


def made(n):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    return [
        (i, " ".join(rng.choice(words[: 1 + rng.randrange(60)]) for _ in range(rng.randrange(40))), "en", "a")
        for i in range(n)
    ]


def same(found, expected):
    found, expected = (sorted(map(tuple, x), key=repr) for x in (found, expected))
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize("at_once", [50, 1 << 21])
def test_scores(spark, monkeypatch, at_once):
    monkeypatch.setattr(lm, "TOKENS_AT_ONCE", at_once)
    rows = [*edges.TEXTS, *made(300), (777, "never seen words", None, None)]
    docs = edges.clashing(edges.documents(spark, rows))
    hand = ByHand(rows)
    same(lm.scores(docs, lm.train(docs)).collect(), [hand.row(d, t) for d, t, *_ in rows])


def test_counts_beyond_a_byte(spark):
    rows = [(1, "a b " * 700, "en", "a"), (2, "a c a b", "en", "a"), (3, "b a", "en", "a")]
    docs = edges.documents(spark, rows)
    hand = ByHand(rows)
    same(lm.scores(docs, lm.train(docs)).collect(), [hand.row(d, t) for d, t, *_ in rows])


def test_probabilities_add_up(spark):
    rows = made(200)
    hand = ByHand(rows)
    for u in (None, b"w0", b"w50", b"unknown"):
        assert sum(hand.p(u, v) for v in hand.words) + hand.p(u, b"no such word") == pytest.approx(1)


def test_held_out_texts_are_harder(spark):
    docs = edges.documents(spark, made(400))
    found = {r.held_out: r.perplexity for r in lm.perplexity(lm.scores(docs, lm.train(docs))).collect()}
    assert 1 < found[False] < found[True] < 61


def test_nothing_to_learn_from(spark):
    docs = edges.documents(spark, [(None, "a b", None, None)])
    (row,) = lm.scores(docs, lm.train(docs)).collect()
    assert tuple(row) == (None, True, 3, 0, 0, 0.0, 0.0)
    none = edges.empty(spark)
    assert lm.scores(none, lm.train(none)).count() == 0
