"""Near duplicates of the pipeline against brute force over all pairs."""

import random

import pytest

import corpus_pipeline
from loadweave.llm import similar
from tests.llm import edges


def shingles(text):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def alike(a, b):
    both = len(a & b)
    return a == b or bool(both) and 100 * both >= 80 * (len(a) + len(b) - both)


def groups_by_hand(texts):
    """For each text the smallest index of its component; the number of pairs below equality."""
    sets, label, pairs = [shingles(t) for t in texts], list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                pairs += sets[i] != sets[j]
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label, pairs


def near_copies(n, seed):
    """Texts over few common words, half of them copies with changes around the limit."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(800)]
    weights = [1 / (i + 1) for i in range(800)]
    texts = [rng.choices(words, weights, k=rng.randint(50, 300)) for _ in range(n // 2)]
    while len(texts) < n:
        copy = list(rng.choice(texts[: n // 2]))
        for _ in range(rng.randint(0, max(1, len(copy) // 35))):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(copy)
    return [" ".join(t) for t in texts]


def kept_ids(spark, texts):
    docs = edges.documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    return {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}


def test_stage_drops_what_the_similarity_says(spark):
    texts = near_copies(600, 3)
    label, pairs = groups_by_hand(texts)
    assert pairs > 100
    # all pairs are found here: recall 1, and nothing below the similarity is dropped
    assert kept_ids(spark, texts) == set(label)


@pytest.mark.parametrize("changed,stays", [(2, False), (3, True)])
def test_limit(spark, changed, stays):
    # of 96 shingles each changed word takes five: 86 / 106 is 0.81, 81 / 111 is 0.73
    text = [f"v{i}" for i in range(100)]
    other = [f"x{i}" if i in (20, 50, 80)[:changed] else w for i, w in enumerate(text)]
    assert kept_ids(spark, [" ".join(text), " ".join(other)]) == ({0, 1} if stays else {0})


def test_one_large_group(spark):
    # a chain would lose nothing, and one task sees all of them
    base = [f"v{i}" for i in range(200)]
    texts = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(200)]
    assert kept_ids(spark, texts) == {0}


def test_odd_documents(spark):
    docs = edges.clashing(edges.documents(spark))
    kept = similar.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = sorted((r.doc_id for r in rows), key=repr)
    assert ids == sorted([1, 3, None, 6, 7, 8, 9, 10, 11, 12, 13, -3], key=repr)
    assert {r.key for r in rows} == {"my key"}
    assert similar.one_of_each(edges.empty(spark)).count() == 0
