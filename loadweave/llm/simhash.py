"""Near duplicates by SimHash: BK-trees per shard, connected components in Spark.

Fingerprint: of whole texts with A-Z in lower case, words between ASCII white
space, shingles of ``words`` words (repeats count; a shorter text is one shingle),
each hashed with XXH64, seed 42, over UTF-8; a bit is 1 if it is set in over half
of the hashes. A text without words, empty or null, has fingerprint 0.

Search: distinct fingerprints only, so copies cost nothing. Two that differ in at
most r bits agree in one of r+1 blocks of bits at least. The value of a block names
a shard; a fingerprint enters r+1 shards, each with a BK-tree of its own, and
queries meet the tree in the shard's task. Sending every tree to every task is not
done: the trees hold all fingerprints and grow with the corpus. A shard of more than
``shard_rows`` fingerprints is cut again by blocks of the bits it does not fix yet,
by the same argument without losing a pair, until all are small or no bits are left.

Each task reports, for each fingerprint with partners, one link to the smallest
that it reaches in the shard; components over these links equal those over all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.llm import bktree
from loadweave.operators.relations import join_aggregated
from loadweave.session import pin

WORDS = 3
RADIUS = 2
SHARD_ROWS = 2000
_HASHES_AT_ONCE = 1 << 16


def fingerprint_of(text: str | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of one text."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*[found[i:] for i in range(words)], strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _HASHES_AT_ONCE):
        part = hashes[start : start + _HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """The fingerprint of a text column as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint_of(t, words) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return of(text)


def _blocks(bits: list[int], parts: int) -> list[int]:
    """Masks that deal the given bit positions into parts."""
    return [sum(1 << b for b in chunk.tolist()) for chunk in np.array_split(bits, parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _free(mask: int) -> list[int]:
    return [b for b in range(64) if not mask >> b & 1]


def _shard(mask: Column, value: Column) -> Column:
    # two shards under one number would only be searched as one
    return F.xxhash64(mask, value.bitwiseAND(mask))


def _sharded(distinct: DataFrame, radius: int, shard_rows: int):
    """Yield frames (shard, value), each of shards of bounded size."""
    masks = _blocks(_free(0), radius + 1)
    rows = distinct.select(
        F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"), "value"
    )
    while True:
        rows = rows.select("mask", _shard(F.col("mask"), F.col("value")).alias("shard"), "value")
        sizes = rows.groupBy("shard").count()
        hot = sizes.filter(F.col("count") > shard_rows).select("shard")
        deeper = {
            m: [m | b for b in _blocks(_free(m), radius + 1)]
            for m in masks
            if len(_free(m)) > radius
        }
        if not deeper or (hot := pin(hot)).isEmpty():
            yield rows.select("shard", "value")
            return
        rows = pin(rows)
        # a shard whose bits are used up stays; it has 2**radius values at most
        yield rows.join(hot, "shard", "left_anti").select("shard", "value")
        cut = F.create_map(
            *[
                x
                for m, into in deeper.items()
                for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(i)) for i in into]))
            ]
        )
        rows = rows.join(hot, "shard", "left_semi").select(
            F.explode(cut[F.col("mask")]).alias("mask"), "value"
        )
        masks = [i for into in deeper.values() for i in into]


def _links_in_shards(radius: int):
    def links(shard: np.ndarray, value: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((value, shard))
        shard, value = shard[order], value[order]
        first = np.concatenate(([True], shard[1:] != shard[:-1])) if len(shard) else np.empty(0, bool)
        several = np.repeat(
            (sizes := np.diff(np.append(np.flatnonzero(first), len(shard)))) > 1, sizes
        )
        shard, value, first = shard[several], value[several], first[several]
        roots = np.flatnonzero(first)[np.cumsum(first) - 1] if len(shard) else np.empty(0, int)
        bits = value.view(np.uint64)
        pairs = bktree.search(roots, bits, bktree.build(roots, bits), radius)
        label = bktree.components(len(value), pairs)
        linked = label != np.arange(len(label))
        return pd.DataFrame({"a": value[linked], "b": value[label[linked]]})

    def run(batches):
        # rows come sorted by shard; a shard that goes on in the next batch waits for it
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not len(batch):
                continue
            shard, value = batch["shard"].to_numpy(), batch["value"].to_numpy()
            last = int(np.searchsorted(shard, shard[-1]))
            if last:
                waiting.append((shard[:last], value[:last]))
                yield links(*map(np.concatenate, zip(*waiting, strict=True)))
                waiting = []
            elif waiting and waiting[-1][0][-1] != shard[0]:
                yield links(*map(np.concatenate, zip(*waiting, strict=True)))
                waiting = []
            waiting.append((shard[last:], value[last:]))
        if waiting:
            yield links(*map(np.concatenate, zip(*waiting, strict=True)))

    return run


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS):
    """Links (a, b), b < a, that connect the distinct values of column ``value``.

    ``a`` and ``b`` differ in bits that other values bridge in steps of ``radius``
    bits at most; the components are those of all pairs within ``radius``.
    """
    found = None
    for rows in _sharded(distinct, radius, shard_rows):
        part = (
            rows.repartition("shard")
            .sortWithinPartitions("shard")
            .mapInPandas(_links_in_shards(radius), "a long, b long")
        )
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def connected(links: DataFrame) -> DataFrame:
    """Rows (a, root), one for each value but the roots: its component's smallest value.

    Large-star and small-star steps in turn (each value and its larger, or smaller,
    neighbours are joined to the smallest): the number of rounds grows with the
    logarithm of the longest chain. Each round is written to the shared folder.
    """
    stars = pin(links.select("a", "b"))
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (
            join_aggregated(both, low, "a")
            .filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            join_aggregated(large, low, "a")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("a"), F.col("low").alias("b")),
                        F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                    )
                ).alias("x")
            )
            .select("x.*")
            .filter(F.col("a") > F.col("b"))
            .distinct()
        )
        next_stars = pin(small)
        done = next_stars.exceptAll(stars).isEmpty() and next_stars.count() == stars.count()
        stars = next_stars
        if done:
            return stars.select("a", F.col("b").alias("root"))


def components(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, value (signed fingerprint), root (smallest value of the component).

    One row per row of ``docs``; other columns are not read.
    """
    prints = pin(docs.select("doc_id", fingerprint(F.col("text"), words).alias("value")))
    roots = connected(fingerprint_links(prints.select("value").distinct(), radius))
    joined = prints.join(roots.withColumnRenamed("a", "value"), "value", "left")
    return joined.select("doc_id", "value", F.coalesce("root", "value").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document.

    ``component_id`` is the smallest ``doc_id`` that links of at most ``radius`` bits
    reach, the document itself included. Null ids are never the smallest; a
    component without any other id has a null one.
    """
    members = pin(components(docs, words, radius))
    smallest = pin(members.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return members.join(smallest, "root").select(
        "doc_id", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The documents that stay, all columns as they are: the smallest id of each component.

    Rows that share id and fingerprint are copies of one document, of which one stays.
    Among documents without id, one of a component stays where no other has an id.
    """
    members = components(docs, words, radius)
    kept = pin(
        members.groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "value")).alias("low"))
        .select(F.col("low.doc_id").alias("_id"), F.col("low.value").alias("_kept"))
    )
    rows = docs.select(F.struct("*").alias("row"), fingerprint(F.col("text"), words).alias("_print"))
    on = [F.col("row.doc_id").eqNullSafe(F.col("_id")), F.col("_print") == F.col("_kept")]
    stay = rows.join(kept, on, "left_semi")
    return stay.dropDuplicates(["_print"]).select("row.*")
