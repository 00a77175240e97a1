import random

import numpy as np
import pytest
import xxhash

from loadweave.llm import bktree, simhash
from tests.llm import edges


def by_hand(text, words=3):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(values, radius):
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if bin(a ^ b).count("1") <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def clustered(n, seed):
    rng = random.Random(seed)
    values = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(values) < n:
        v = rng.choice(values)
        for _ in range(rng.randint(1, 3)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    return sorted(set(values))


@pytest.mark.parametrize("text", [t for _, t, *_ in edges.TEXTS])
def test_fingerprint(text):
    assert simhash.fingerprint_of(text) == by_hand(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_tree_finds_all_pairs(radius):
    values = np.array(clustered(300, 1), np.uint64)
    roots = np.where(np.arange(len(values)) < 100, 0, 100)
    pairs = {
        (int(a), int(b))
        for i, j in bktree.search(roots, values, bktree.build(roots, values), radius, chunk=37)
        for a, b in zip(i, j, strict=True)
    }
    expected = {
        (i, j)
        for i in range(len(values))
        for j in range(i)
        if roots[i] == roots[j] and bin(int(values[i]) ^ int(values[j])).count("1") <= radius
    }
    assert pairs == expected


@pytest.mark.parametrize("shard_rows", [4, 2000])
def test_components_of_links(spark, shard_rows):
    values = clustered(240, 2)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "value long")
    roots = {
        r.a: r.root
        for r in simhash.connected(simhash.fingerprint_links(frame, 2, shard_rows)).collect()
    }
    label = components_by_hand(values, 2)
    groups, expected = {}, {}
    for v, at in zip(signed, label, strict=True):
        groups.setdefault(at, []).append(v)
    for group in groups.values():
        expected |= {v: min(group) for v in group if v != min(group)}
    assert roots == expected


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)], "a long, b long")
    assert {(r.a, r.root) for r in simhash.connected(links).collect()} == {
        (i, 0) for i in range(1, 41)
    }


def test_documents(spark):
    docs = edges.clashing(edges.documents(spark))
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(edges.TEXTS)
    values = [by_hand(t) for _, t, *_ in edges.TEXTS]
    label = components_by_hand(values, 2)
    lowest = {}
    for (doc_id, *_), at in zip(edges.TEXTS, label, strict=True):
        if doc_id is not None:
            lowest[at] = min(lowest.get(at, doc_id), doc_id)
    expected = [
        (d, f"{v:016x}", lowest.get(at))
        for (d, *_), v, at in zip(edges.TEXTS, values, label, strict=True)
    ]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_one_of_each_group_stays(spark):
    docs = edges.clashing(edges.documents(spark))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    # 1 stays for 1, 2, 2; 3 for all without words; the one without id as there is no other
    ids = sorted((r.doc_id for r in rows), key=repr)
    assert ids == sorted([1, 3, None, 6, 7, 8, 9, 10, 11, 12, 13, -3], key=repr)
    assert {r.key for r in rows} == {"my key"}


def test_empty_table(spark):
    assert simhash.near_duplicates(edges.empty(spark)).count() == 0
    assert simhash.one_of_each(edges.empty(spark)).count() == 0
