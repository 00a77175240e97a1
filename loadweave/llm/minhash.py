"""Near duplicates by MinHash, with sequential Bayesian verification of candidates.

Texts are linked if the sets of their shingles of ``words`` words (A-Z in lower case, words between
ASCII white space; a text of fewer words is one shingle) have a Jaccard similarity of
``percent`` or more. Classes are the components of the links. A text without words, null or
empty, has no shingles and is linked with nothing. Equal sets are one node.

1. Candidates agree in all ``ROWS`` minima of one of ``BANDS`` bands: at a similarity of 0.8 a
   pair agrees in none with a chance of (1 - 0.8**6)**24, under 0.07 %.
2. Verification, in sequence: candidates of a bucket compare their signatures, ``SAMPLES`` further
   minima of which 8 bits are kept, ``STEP`` at a time. After n of them with m agreements the similarity S
   has, from a flat prior, the posterior Beta(m + 1, n - m + 1); the pair is dropped as soon as
   P(S >= percent) falls below ``MISS``, the chosen chance to miss a pair at each step. Agreement by
   chance, one in 256, only keeps pairs that would be dropped.
3. Survivors are verified on their full sets (64-bit hashes of shingles), in the task of the
   component of survivors. Only their texts are read into sets again and moved (``inplace``).

Buckets of more than ``BUCKET_ROWS`` nodes and components of more than ``SHINGLES_AT_ONCE`` shingles are
cut into blocks, without losing a pair (``blocks``): a pivot first, and pairs that it leaves open. Copies and
near copies that are connected already are not compared again, so a group of any size costs
few comparisons per member.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.llm import blocks, inplace, simhash
from loadweave.llm.shingles import ODD, Hashes, mixed, shingle_bytes, shingle_set, similar_sets, word_hashes
from loadweave.operators.relations import join_aggregated
from loadweave.session import pin

WORDS = 2
PERCENT = 80
BANDS = 24
ROWS = 6
SAMPLES = 128
STEP = 32
MISS = 1e-4
BUCKET_ROWS = 4096
SHINGLES_AT_ONCE = 1 << 20
_HASHES_AT_ONCE = 1 << 16
_FACTORS = np.random.default_rng(11).integers(1 << 63, size=BANDS * ROWS + SAMPLES, dtype=np.uint64) * np.uint64(
    2
) + np.uint64(1)


def minima(shingles: np.ndarray, factors: np.ndarray = _FACTORS) -> np.ndarray:
    """The smallest value under each hash function; ``shingles`` are not empty."""
    step = max(1, _HASHES_AT_ONCE // len(factors))
    least = np.full(len(factors), np.uint64((1 << 64) - 1))
    for start in range(0, len(shingles), step):
        part = (factors[:, None] * shingles[None, start : start + step]).min(axis=1)
        least = np.minimum(least, part)
    return least


def _signature(least: np.ndarray) -> bytes:
    """Of the minima under the last ``SAMPLES`` hash functions."""
    return mixed(least).astype(np.uint8).tobytes()


def features_of(h: np.ndarray, words: int = WORDS) -> tuple[int, int, bytes, np.ndarray]:
    """node, size, signature and buckets of the text whose words hash to ``h``."""
    shingles = shingle_set(h, words)
    if not len(shingles):
        return 0, 0, b"", np.empty(0, np.int64)
    node = xxhash.xxh64_intdigest(shingles.tobytes(), 42)
    least = minima(shingles)
    bucket = np.arange(BANDS, dtype=np.uint64)
    for column in least[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        bucket = mixed(bucket * ODD + column)
    signature = _signature(least[BANDS * ROWS :])
    return node - (node >> 63 << 64), len(shingles), signature, bucket.view(np.int64)


def features(text: Column, words: int = WORDS) -> Column:
    @F.pandas_udf("node long, size long, signature binary, buckets array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        known = Hashes()
        rows = [features_of(word_hashes(t, known), words) for t in texts]
        return pd.DataFrame(rows, columns=["node", "size", "signature", "buckets"])

    return of(text)


def fewest_agreements(percent: int, miss: float, samples: int = SAMPLES, step: int = STEP) -> list[tuple[int, int]]:
    """(n, m): after n samples, fewer than m agreements leave less than ``miss`` for the similarity.

    With a flat prior P(S >= t) after m of n is the chance that n + 1 trials of t have at most m successes.
    """
    t, found = percent / 100, []
    for n in range(step, samples + 1, step):
        at_most = np.cumsum([comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(n + 1)])
        found.append((n, int(np.searchsorted(at_most, miss))))
    return found


def sequential_test(rows: pa.Table, percent: int, miss: float):
    """linked(i, j): which pairs the signatures leave; most are dropped after the first samples."""
    size = rows.column("size").to_numpy()
    signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(len(rows), SAMPLES)
    limits = fewest_agreements(percent, miss)

    def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        # a similarity bounds the ratio of sizes
        alive = np.flatnonzero(np.minimum(size[i], size[j]) * 100 >= np.maximum(size[i], size[j]) * percent)
        agreed, before = np.zeros(len(alive), np.int64), 0
        for n, least in limits:
            same = signature[i[alive], before:n] == signature[j[alive], before:n]
            agreed += same.sum(axis=1)
            stays = agreed >= least
            alive, agreed, before = alive[stays], agreed[stays], n
        ok = np.zeros(len(i), bool)
        ok[alive] = True
        return ok

    return linked


def _likely(percent: int, miss: float):
    return blocks.by_pairs(lambda rows: sequential_test(rows, percent, miss))


def _confirmed(percent: int, miss: float):
    def test(rows: pa.Table):
        # signatures are made again where the sets are: they would be most of what is moved but the sets
        sets = rows.column("shingles").combine_chunks()
        found = (np.frombuffer(x.as_buffer(), np.uint64) for x in sets)
        made = pa.array([_signature(minima(x, _FACTORS[BANDS * ROWS :])) for x in found], pa.binary())
        likely = sequential_test(rows.append_column("signature", made), percent, miss)
        alike = similar_sets(sets, percent)

        def linked(i, j):
            ok = likely(i, j)
            ok[ok] = alike(i[ok], j[ok])
            return ok

        return linked

    return blocks.by_pairs(test)


def roots(
    rows: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    miss: float = MISS,
    bucket_rows: int = BUCKET_ROWS,
    shingles_at_once: int = SHINGLES_AT_ONCE,
) -> DataFrame:
    """node, root (smallest node of its class) for all nodes that are not the smallest.

    ``rows`` is pinned and has the features, ``text`` and the number ``n``.
    """
    nodes = pin(
        rows.filter("size > 0")
        .groupBy("node")
        .agg(F.min(F.struct("n", "size", "signature", "buckets")).alias("x"))
        .select("node", "x.*")
    )
    places = nodes.select(F.explode("buckets").alias("key"), "node", F.lit(1).cast("long").alias("weight"))

    def with_signatures(placed: DataFrame) -> DataFrame:
        return placed.join(nodes.select("node", "size", "signature"), "node")

    likely = blocks.links(places, _likely(percent, miss), bucket_rows, with_signatures)
    survivors = simhash.connected(likely.distinct())
    groups = survivors.select(F.col("a").alias("node"), F.col("root").alias("key"))
    tops = groups.select(F.col("key").alias("node"), "key").distinct()
    narrow = nodes.select("node", "n", "size")
    members = pin(groups.unionByName(tops).join(narrow.select("node", F.col("size").alias("weight")), "node"))

    def with_sets(placed: DataFrame) -> DataFrame:
        wanted = placed.join(narrow, "node")
        return inplace.joined(rows, wanted, "text", "shingles", shingle_bytes(words), 8 * shingles_at_once)

    confirmed = blocks.links(members, _confirmed(percent, miss), shingles_at_once, with_sets)
    return simhash.connected(confirmed.distinct()).select(F.col("a").alias("node"), "root")


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, **bounds) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the class), kept (that document).

    One row per row of ``docs``; rows with one doc_id are documents of their own. Null ids are
    never the smallest; a class without any other id has a null one, and keeps its rows.
    """
    rows = pin(
        docs.select(
            "doc_id", "text", features(F.col("text"), words).alias("x"), F.monotonically_increasing_id().alias("n")
        ).select("doc_id", "text", "x.*", "n")
    )
    found = roots(rows, words, percent, **bounds)
    members = rows.filter("size > 0").select("doc_id", "node", "size").join(found, "node", "left")
    members = pin(members.select("doc_id", "size", F.coalesce("root", "node").alias("root")))
    smallest = members.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = join_aggregated(members, smallest, "root").select("doc_id", "size", "component_id")
    alone = rows.filter("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
