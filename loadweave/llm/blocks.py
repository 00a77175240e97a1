"""Links between the members of keys, where a key may have any number of members.

1. Members of one key (a shard, a bucket, a group of candidates) meet in blocks of bounded weight, each a
   task of its own, together with the key's pivot, its smallest node. They are joined within the
   block. Those that come out connected with the pivot are connected with each other, over all blocks.
2. What is not, the loose members of keys of several blocks, is compared with all members of the key,
   in tasks of one block and one block of loose members each. These blocks are larger, as their number
   decides how often rows are sent. No pair is lost: of two members that are not both
   connected with the pivot one is loose. A key that is one group of near copies has few loose
   members, so the work stays in proportion to its size.

A task compares each member with its key's first one, and then only pairs that are not
connected yet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.llm import bktree
from loadweave.operators.relations import join_aggregated
from loadweave.session import pin

_PAIRS_AT_ONCE = 1 << 18
# blocks of the first step are that much lighter than those of the second
_LIGHTER = 32


def _merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return bktree.components(len(label), [(np.arange(len(label)), label), (i, j)])


def join_pairs(
    run: np.ndarray, label: np.ndarray, asks: np.ndarray | None, linked: Callable
) -> np.ndarray:
    """For each row the smallest index of its component in its run.

    ``run`` numbers the runs of rows, ``label`` the components so far. Pairs of a run,
    or those of a row that ``asks`` and one that does not, are tested by
    ``linked(i, j)``, unless they are connected already.
    """
    first, end = np.searchsorted(run, run), np.searchsorted(run, run, side="right")

    def tested(i, j):
        keep = label[i] != label[j]
        if asks is not None:
            keep &= asks[i] != asks[j]
        i, j = i[keep], j[keep]
        ok = linked(i, j)
        return i[ok], j[ok]

    label = _merged(label, *tested(first, np.arange(len(run))))
    starts = np.unique(first)
    # runs that are not one component yet
    open_ = np.logical_or.reduceat(label != label[first], starts)
    for a in starts[open_].tolist():
        b = int(end[a])
        i = a
        while i < b:
            many = max(1, _PAIRS_AT_ONCE // (b - a))
            some = np.arange(i, min(i + many, b))
            i += many
            x, y = (v.ravel() for v in np.meshgrid(some, np.arange(a, b), indexing="ij"))
            x, y = tested(x[x < y], y[x < y])
            if len(x):
                label[a:b] = _merged(label[a:b] - a, x - a, y - a) + a
    return label


def by_pairs(test: Callable) -> Callable:
    """A joiner (rows, run, label, asks) -> label, from ``test(rows)`` that gives ``linked``."""

    def join(rows: pa.Table, run, label, asks):
        return join_pairs(run, label, asks, test(rows))

    return join


def _runs(batches, keys: list[str]):
    """(rows, run number of each), in tables of whole runs; rows come sorted by the keys."""
    waiting = None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if waiting is None else pa.concat_tables([waiting, rows])
        run = _numbered(rows, keys)
        last = int(np.searchsorted(run, run[-1]))
        if last:
            yield rows.slice(0, last).combine_chunks(), run[:last]
        waiting = rows.slice(last)
    if waiting is not None:
        yield waiting.combine_chunks(), _numbered(waiting, keys)


def _numbered(rows: pa.Table, keys: list[str]) -> np.ndarray:
    changes = np.zeros(len(rows), np.int64)
    for key in keys:
        column = rows.column(key).to_numpy()
        changes[1:] |= column[1:] != column[:-1]
    return np.cumsum(changes)


def _within(join: Callable):
    def run(batches):
        for rows, runs in _runs(batches, ["key", "block"]):
            n = len(rows)
            label = join(rows, runs, np.arange(n), None)
            first = np.searchsorted(runs, runs)
            split = rows.column("split").to_numpy(zero_copy_only=False)
            node = rows.column("node").to_numpy()
            yield pa.record_batch(
                [
                    rows.column("key").combine_chunks(),
                    pa.array(node),
                    pa.array(node[label]),
                    # the pivot is the smallest node, so the first row
                    pa.array(split & (label != first)),
                ],
                names=["key", "node", "root", "loose"],
            )

    return run


def _across(join: Callable):
    def run(batches):
        for rows, runs in _runs(batches, ["key", "block", "turn"]):
            node, root = (rows.column(c).to_numpy() for c in ("node", "root"))
            # members of one component so far start as one
            order = np.lexsort((np.arange(len(rows)), root, runs))
            new = np.ones(len(rows), bool)
            new[1:] = (runs[order][1:] != runs[order][:-1]) | (root[order][1:] != root[order][:-1])
            label = np.empty(len(rows), np.int64)
            label[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            asks = rows.column("asks").to_numpy(zero_copy_only=False)
            label = join(rows, runs, label, asks)
            # a loose member may also meet itself
            linked = node != node[label]
            yield pa.record_batch([pa.array(node[linked]), pa.array(node[label[linked]])], names=["a", "b"])

    return run


def _count(weight, at_once: int):
    return F.ceil(weight / F.lit(float(at_once))).cast("long")


def _place(node: str, blocks: str, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), node), F.col(blocks))


def _every(blocks: str):
    return F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)


def links(members: DataFrame, join: Callable, at_once: int, attach: Callable) -> DataFrame:
    """Links (a, b) between nodes that connect what ``join`` finds in each key.

    ``members`` has key, node and weight, all long, and is read twice. ``attach`` adds what
    ``join`` reads, for the members of keys with two of them at least. ``at_once`` bounds the
    weight of a block.
    """
    keys = members.groupBy("key").agg(
        F.min("node").alias("pivot"), F.sum("weight").alias("w"), F.count("*").alias("many")
    )
    keys = keys.filter("many > 1").select(
        "key",
        "pivot",
        _count(F.col("w"), max(1, at_once // _LIGHTER)).alias("light"),
        _count(F.col("w"), at_once).alias("blocks"),
    )
    placed = pin(join_aggregated(members, keys, "key"))
    own = F.array(_place("node", "light", 0))
    first = placed.select(
        "key",
        "node",
        F.explode(F.when(F.col("node") == F.col("pivot"), _every("light")).otherwise(own)).alias("block"),
        (F.col("light") > 1).alias("split"),
    )
    found = pin(
        attach(first)
        .repartition("key", "block")
        .sortWithinPartitions("key", "block", "node")
        .mapInArrow(_within(join), "key long, node long, root long, loose boolean")
    )
    near = found.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    loose = found.filter("loose").select("key", "node")
    if loose.isEmpty():
        return near
    loose = placed.join(loose, ["key", "node"], "left_semi")
    turns = loose.groupBy("key").agg(_count(F.sum("weight"), at_once).alias("turns"))
    # the pivot is in many blocks with one root: itself
    roots = found.select("key", "node", "root").distinct()
    both = join_aggregated(placed, turns, "key").join(roots, ["key", "node"])
    asking = both.join(loose.select("key", "node"), ["key", "node"], "left_semi")
    seen = both.select(
        "key", "node", "root", _place("node", "blocks", 1).alias("block"), F.explode(_every("turns")).alias("turn")
    )
    asking = asking.select(
        "key", "node", "root", F.explode(_every("blocks")).alias("block"), _place("node", "turns", 2).alias("turn")
    )
    more = (
        attach(seen.withColumn("asks", F.lit(False)).unionByName(asking.withColumn("asks", F.lit(True))))
        .repartition("key", "block", "turn")
        .sortWithinPartitions("key", "block", "turn", "node")
        .mapInArrow(_across(join), "a long, b long")
    )
    return near.unionByName(more)
