"""Near duplicates by Jaccard similarity of word shingles, found through BK-trees.

Two texts are linked if the sets of their shingles of ``words`` words (A-Z in lower
case, words between ASCII white space; a shorter text is one shingle, one without words
has none) have a Jaccard similarity of ``percent`` or more. Groups are the components.

Texts with equal sets are one node. Shards are buckets of MinHash bands: nodes that agree in
all ``ROWS`` minima of one of ``BANDS`` bands. A pair at the similarity of 0.8 shares none with a
chance of (1 - 0.8**4)**16, under 0.03 %; nodes with little in common share none, so
shards stay small whatever the corpus, except for one that is a group of near copies. Blocks of
fingerprint bits as in ``simhash`` would not do: at the radius needed here they are
so short that most pairs of one language agree in one.

In its shard each node searches the BK-tree of SimHashes within ``RADIUS`` bits. Features
are words, each weighted by the square root of its count. Candidates meet with their
shingle sets in the task of their component of candidates, which links those that the sets themselves
confirm. So no pair below the similarity is linked; what the search misses is measured in
the README. Shingles are compared by 64-bit hashes.

Shards of more than ``SHARD_ROWS`` nodes and groups of more than ``SHINGLES_AT_ONCE`` shingles are
cut into blocks (``blocks``) without losing a pair. Only the texts of candidates are read into sets and
moved, and documents that go are left out where they lie (``inplace``), by one plan for all sizes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.llm import blocks, bktree, inplace, simhash
from loadweave.llm.shingles import ODD, Hashes, mixed, shingle_bytes, shingle_set, similar_sets, word_hashes
from loadweave.operators.relations import join_aggregated
from loadweave.session import pin

WORDS = 5
PERCENT = 80
RADIUS = 16
BANDS = 16
ROWS = 4
SHARD_ROWS = 1 << 16
SHINGLES_AT_ONCE = 1 << 20
_HASHES_AT_ONCE = 1 << 16
_PAIRS_AT_ONCE = 1 << 20
_FACTORS = np.random.default_rng(42).integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _print(hashes: np.ndarray, weights: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _HASHES_AT_ONCE):
        part = hashes[start : start + _HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1, bitorder="little")
        ones += weights[start : start + _HASHES_AT_ONCE] @ bits.astype(np.int64)
    bits = (2 * ones > weights.sum()).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def bands(shingles: np.ndarray) -> np.ndarray:
    """The bucket of each band; ``shingles`` are not empty."""
    step = max(1, _HASHES_AT_ONCE // len(_FACTORS))
    least = np.full(len(_FACTORS), np.uint64((1 << 64) - 1))
    for start in range(0, len(shingles), step):
        part = (_FACTORS[:, None] * shingles[None, start : start + step]).min(axis=1)
        least = np.minimum(least, part)
    total = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        total = mixed(total * ODD + column)
    return total.view(np.int64)


def features_of(h: np.ndarray, words: int = WORDS) -> tuple[int, int, int, np.ndarray]:
    """node, value, size and shards of the text whose words hash to ``h``."""
    if not len(h):
        return 0, 0, 0, np.empty(0, np.int64)
    shingles = shingle_set(h, words)
    node = xxhash.xxh64_intdigest(shingles.tobytes(), 42)
    single, count = np.unique(h, return_counts=True)
    weights = np.rint(np.sqrt(count) * 64).astype(np.int64)
    return node - (node >> 63 << 64), _print(single, weights), len(shingles), bands(shingles)


def features(text: Column, words: int = WORDS) -> Column:
    @F.pandas_udf("node long, value long, size long, shards array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        known = Hashes()
        rows = [features_of(word_hashes(t, known), words) for t in texts]
        return pd.DataFrame(rows, columns=["node", "value", "size", "shards"])

    return of(text)


def _close(value, size, i, j, percent: int, radius: int):
    """Which of the pairs (i, j) are candidates."""
    return (np.minimum(size[i], size[j]) * 100 >= np.maximum(size[i], size[j]) * percent) & (
        np.bitwise_count(value[i] ^ value[j]) <= radius
    )


def _by_trees(percent: int, radius: int):
    """Candidates of each shard, found in its BK-tree."""

    def join(rows: pa.Table, run, label, asks):
        value, size = rows.column("value").to_numpy().view(np.uint64), rows.column("size").to_numpy()
        inside = np.arange(len(rows)) if asks is None else np.flatnonzero(~asks)
        roots = np.searchsorted(run[inside], run[inside])
        trees = bktree.build(roots, value[inside])
        outside, others = inside, None
        if asks is not None:
            outside = np.flatnonzero(asks)
            at = np.searchsorted(run[inside], run[outside])
            # a block may have no member of the shard
            met = at < len(inside)
            met[met] = run[inside][at[met]] == run[outside][met]
            outside, others = outside[met], (at[met], value[outside[met]])
        pairs, held = [], 0
        for i, j in bktree.search(roots, value[inside], trees, radius, 1024, others):
            i, j = outside[i], inside[j]
            keep = _close(value, size, i, j, percent, radius)
            pairs.append((i[keep], j[keep]))
            held += int(keep.sum())
            if held > _PAIRS_AT_ONCE:
                label = bktree.components(len(rows), [(np.arange(len(rows)), label), *pairs])
                pairs, held = [], 0
        return bktree.components(len(rows), [(np.arange(len(rows)), label), *pairs])

    return join


def _confirmed(percent: int, radius: int):
    def test(rows: pa.Table):
        value, size = rows.column("value").to_numpy().view(np.uint64), rows.column("size").to_numpy()
        alike = similar_sets(rows.column("shingles").combine_chunks(), percent)

        def linked(i, j):
            ok = _close(value, size, i, j, percent, radius)
            ok[ok] = alike(i[ok], j[ok])
            return ok

        return linked

    return blocks.by_pairs(test)


def roots(
    rows: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    radius: int = RADIUS,
    shard_rows: int = SHARD_ROWS,
    shingles_at_once: int = SHINGLES_AT_ONCE,
) -> DataFrame:
    """node, root (smallest node of its group) for all nodes that are not the smallest.

    ``rows`` is pinned and has the features, ``text`` and the number ``n``.
    """
    nodes = pin(
        rows.groupBy("node")
        .agg(F.min(F.struct("n", "value", "size", "shards")).alias("x"))
        .select("node", "x.*")
    )
    sharded = nodes.select(F.explode("shards").alias("key"), "node", F.lit(1).cast("long").alias("weight"))

    def with_values(placed: DataFrame) -> DataFrame:
        return placed.join(nodes.select("node", "value", "size"), "node")

    found = blocks.links(sharded, _by_trees(percent, radius), shard_rows, with_values)
    groups = simhash.connected(found.distinct())
    groups = groups.select(F.col("a").alias("node"), F.col("root").alias("key"))
    tops = groups.select(F.col("key").alias("node"), "key").distinct()
    narrow = nodes.select("node", "n", "value", "size")
    members = pin(groups.unionByName(tops).join(narrow.select("node", F.col("size").alias("weight")), "node"))

    def with_sets(placed: DataFrame) -> DataFrame:
        wanted = placed.join(narrow, "node")
        return inplace.joined(rows, wanted, "text", "shingles", shingle_bytes(words), 8 * shingles_at_once)

    confirmed = blocks.links(members, _confirmed(percent, radius), shingles_at_once, with_sets)
    return simhash.connected(confirmed.distinct()).select(F.col("a").alias("node"), "root")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, **bounds) -> DataFrame:
    """The documents that stay, all columns as they are: the smallest id of each group.

    Among documents without id, one of a group stays where no other has an id. Texts
    without words are equal to each other, null or empty: one of them stays.
    """
    rows = pin(
        docs.select(
            F.struct("*").alias("row"),
            features(F.col("text"), words).alias("x"),
            F.monotonically_increasing_id().alias("n"),
        ).select("row", "x.*", "n")
    )
    found = roots(rows.withColumn("text", F.col("row.text")), words, percent, **bounds)
    members = rows.select("node", F.col("row.doc_id").alias("doc_id"), "n").join(found, "node", "left")
    members = pin(members.select(F.coalesce("root", "node").alias("root"), "doc_id", "n"))
    lowest = members.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "n")).alias("low"), F.count("*").alias("many")
    )
    # narrow rows say which texts go; those are left out where they lie
    gone = join_aggregated(members, lowest.filter("many > 1"), "root").filter("n != low.n")
    return inplace.without(rows.select("row", "n"), gone.select("n")).select("row.*")
