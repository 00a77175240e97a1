"""MinHash classes against brute force over all pairs, blocks of any size."""

import random

import numpy as np
import pytest

from loadweave.llm import minhash, similar
from loadweave.llm.shingles import word_hashes
from tests.llm import edges


def shingles(text, words=2):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def by_hand(docs, words=2):
    """(doc_id, n_shingles, component_id, kept) of each of the (doc_id, text)."""
    sets, label = [shingles(t, words) for _, t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    ids = {}
    for (doc_id, _), at in zip(docs, label, strict=True):
        ids.setdefault(at, []).append(doc_id)
    least = {at: min((d for d in found if d is not None), default=None) for at, found in ids.items()}
    return sorted(
        ((d, len(s), least[at], d == least[at]) for (d, _), s, at in zip(docs, sets, label, strict=True)), key=repr
    )


def found(spark, docs, **bounds):
    df = edges.documents(spark, [(d, t, "en", "a") for d, t in docs])
    return sorted((tuple(r) for r in minhash.classes(df.repartition(5), **bounds).collect()), key=repr)


def near_copies(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(800)]
    weights = [1 / (i + 1) for i in range(800)]
    texts = [rng.choices(words, weights, k=rng.randint(30, 200)) for _ in range(n // 2)]
    while len(texts) < n:
        copy = list(rng.choice(texts[: n // 2]))
        for _ in range(rng.randint(0, max(1, len(copy) // 15))):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(copy)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def one_group(n, seed, size=120):
    """Near copies of one text, some of them too far from it but near each other, and copies."""
    rng = random.Random(seed)
    base = [f"v{i}" for i in range(size)]
    far = [w if i % 9 else "y" + w for i, w in enumerate(base)]
    texts = []
    for i in range(n):
        text = list(far if i % 7 == 0 else base)
        for _ in range(rng.randint(0, 7)):
            text[rng.randrange(size)] = f"x{rng.randrange(1000)}"
        texts.append((i, " ".join(text)))
    return texts + [(n + i, t) for i, (_, t) in enumerate(texts[:20])]


def test_against_all_pairs(spark):
    docs = near_copies(500, 1)
    expected = by_hand(docs)
    assert sum(not x[3] for x in expected) > 100
    assert found(spark, docs) == expected


@pytest.mark.parametrize("bucket_rows,shingles_at_once", [(5, 1 << 20), (1 << 16, 1500), (7, 700)])
def test_one_group_over_many_blocks(spark, bucket_rows, shingles_at_once):
    docs = one_group(160, 2)
    expected = by_hand(docs)
    assert 1 < len({x[2] for x in expected}) < 60
    assert found(spark, docs, bucket_rows=bucket_rows, shingles_at_once=shingles_at_once) == expected


@pytest.mark.parametrize("shard_rows,shingles_at_once", [(5, 1 << 20), (1 << 16, 1500), (7, 700)])
def test_pipeline_stage_over_many_blocks(spark, shard_rows, shingles_at_once):
    # the stage's own candidates and blocks, by five words
    docs = one_group(160, 4, size=300)
    df = edges.documents(spark, [(d, t, "en", "a") for d, t in docs]).repartition(5)
    kept = similar.one_of_each(df, shard_rows=shard_rows, shingles_at_once=shingles_at_once)
    expected = {d for d, _, _, stays in by_hand(docs, 5) if stays}
    assert 1 < len(expected) < 100
    assert {r.doc_id for r in kept.collect()} == expected


def test_posterior():
    # against the beta distribution by numeric integration
    x = np.linspace(0, 1, 400_001)
    for n, least in minhash.fewest_agreements(80, 1e-4):
        for m in (least - 1, least):
            density = x**m * (1 - x) ** (n - m)
            posterior = density[x >= 0.8].sum() / density.sum()
            assert (posterior < 1e-4) == (m < least)


def test_miss_and_pruning_of_the_test():
    # sets of 1,000 numbers at similarities above and below the limit
    import pyarrow as pa

    rng = np.random.default_rng(3)

    def pairs(similarity, n=300):
        both = round(2000 * similarity / (1 + similarity))
        rows = []
        for _ in range(n):
            x = rng.integers(1 << 63, size=3000, dtype=np.uint64)
            rows += [x[:1000], np.concatenate([x[1000 - both : 1000], x[1000 : 2000 - both]])]
        signature = [minhash.mixed(minhash.minima(s)[-minhash.SAMPLES :]).astype(np.uint8).tobytes() for s in rows]
        table = pa.table({"size": [1000] * len(rows), "signature": pa.array(signature, pa.binary())})
        linked = minhash.sequential_test(table, 80, minhash.MISS)
        return linked(np.arange(0, 2 * n, 2), np.arange(1, 2 * n, 2)).mean()

    assert pairs(0.8) >= 0.99
    assert pairs(0.9) == 1
    assert pairs(0.5) <= 0.02


def test_limit_is_exact(spark):
    # 100 shingles each; 11 of them other: 89 / 111 is 0.8018, 12: 88 / 112 is 0.786
    base = [f"v{i}" for i in range(101)]
    for other, linked in ((11, True), (12, False)):
        copy = base[: 101 - other] + [f"z{i}" for i in range(other)]
        docs = [(1, " ".join(base)), (2, " ".join(copy))]
        assert found(spark, docs)[1][2] == (1 if linked else 2)
        assert found(spark, docs) == by_hand(docs)


def test_odd_documents(spark):
    docs = edges.clashing(edges.documents(spark))
    got = minhash.classes(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    expected = by_hand([(d, t) for d, t, *_ in edges.TEXTS])
    # a null id that nothing links is its class's own
    expected = [(d, n, c, d == c) for d, n, c, _ in expected]
    assert rows == expected
    assert minhash.classes(edges.empty(spark)).count() == 0


def test_words():
    assert len(word_hashes("A b\tc\n\nd\x0be")) == 5
    assert len(word_hashes(None)) == 0


def test_sets_are_moved_without_signatures(spark, monkeypatch):
    moved, joined = [], minhash.inplace.joined

    def seen(rows, numbers, *args):
        moved.append(numbers.columns)
        return joined(rows, numbers, *args)

    monkeypatch.setattr(minhash.inplace, "joined", seen)
    words = [f"v{i}" for i in range(101)]
    docs = [(k, " ".join([*words, f"z{k}"])) for k in range(6)]
    assert found(spark, docs) == by_hand(docs)
    assert moved and not any("signature" in columns for columns in moved)
    # those made again are those of the features
    h = word_hashes(docs[0][1])
    again = minhash.minima(minhash.shingle_set(h, 2), minhash._FACTORS[-minhash.SAMPLES :])
    assert minhash._signature(again) == minhash.features_of(h)[2]
