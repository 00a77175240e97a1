"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows are numbered in the order of their keys. A permutation of the numbers
0..n-1, fixed by a seed, gives each row a place; the place modulo the number of
shards is its shard and the place divided by it its slot. So shard sizes differ
by one row at most, and both directions can be computed from numbers alone:
``place_of`` for a row number, ``row_of`` for a shard and slot.

The permutation works on a grid of a x b cells, a*b >= n, less than a cells too
many. A value that lands beyond n-1 is permuted again until it does not (cycle
walking). A walk visits distinct surplus cells, so it takes at most as many steps
as there are. ``WALK`` steps are enough for every n up to WALK**2 by that bound; for
larger n the chance to need more is below WALK**-WALK, and then the query fails
rather than giving a wrong place.
"""

from __future__ import annotations

import math
import struct

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.functions.ordered import dense_ids
from loadweave.llm.common import let

SEED = 20260101
ROUNDS = 4  # pairs of half rounds
WALK = 64


def _grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _keys(seed: int) -> list[tuple[int, int]]:
    return [(seed + 2 * i, seed + 2 * i + 1) for i in range(ROUNDS)]


def _key_pairs(seed: int, back: bool = False) -> Column:
    pairs = _keys(seed)[::-1] if back else _keys(seed)
    return F.array(
        *[F.struct(F.lit(p).cast("long").alias("p"), F.lit(q).cast("long").alias("q")) for p, q in pairs]
    )


def _once(x: Column, n: int, seed: int) -> Column:
    a, b = (F.lit(v).cast("long") for v in _grid(n))

    def rounds(s, k):
        return let(
            F.pmod(s["l"] + F.pmod(F.xxhash64(k["p"], s["r"]), a), a),
            lambda left: F.struct(
                left.alias("l"),
                F.pmod(s["r"] + F.pmod(F.xxhash64(k["q"], left), b), b).alias("r"),
            ),
        )

    start = F.struct(F.call_function("div", x, b).alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(_key_pairs(seed), start, rounds, lambda s: s["l"] * b + s["r"])


def _once_back(x: Column, n: int, seed: int) -> Column:
    a, b = (F.lit(v).cast("long") for v in _grid(n))

    def rounds(s, k):
        return let(
            F.pmod(s["r"] - F.pmod(F.xxhash64(k["q"], s["l"]), b), b),
            lambda right: F.struct(
                F.pmod(s["l"] - F.pmod(F.xxhash64(k["p"], right), a), a).alias("l"),
                right.alias("r"),
            ),
        )

    start = F.struct(F.call_function("div", x, b).alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(_key_pairs(seed, back=True), start, rounds, lambda s: s["l"] * b + s["r"])


def _walked(x: Column, n: int, seed: int, step) -> Column:
    size = F.lit(n).cast("long")

    def walk(y):
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(WALK)),
            y,
            lambda at, _: F.when(at >= size, step(at, n, seed)).otherwise(at),
            lambda at: F.when(at < size, at).otherwise(
                F.raise_error(F.lit("cycle walk too long; use another seed")).cast("long")
            ),
        )

    return let(step(x, n, seed), lambda y: F.when(y >= size, walk(y)).otherwise(y))


def permuted(x: Column, n: int, seed: int = SEED) -> Column:
    """The place of row number ``x`` (0 to n-1) among n."""
    return _walked(x.cast("long"), n, seed, _once)


def unpermuted(place: Column, n: int, seed: int = SEED) -> Column:
    """The row number whose place is ``place``."""
    return _walked(place.cast("long"), n, seed, _once_back)


def _hash(key: int, value: int) -> int:
    h = xxhash.xxh64_intdigest(
        struct.pack("<q", value), xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    )
    return h - (1 << 64) if h >> 63 else h


def place_of(row: int, n: int, seed: int = SEED) -> int:
    """``permuted`` of one number, without Spark."""
    a, b = _grid(n)
    while True:
        left, right = divmod(row, b)
        for p, q in _keys(seed):
            left = (left + _hash(p, right) % a) % a
            right = (right + _hash(q, left) % b) % b
        row = left * b + right
        if row < n:
            return row


def row_of(shard: int, slot: int, shards: int, n: int, seed: int = SEED) -> int:
    """The row number that sits in a slot of a shard, without Spark."""
    a, b = _grid(n)
    place = slot * shards + shard
    if not (0 <= shard < shards and 0 <= slot and place < n):
        raise ValueError("no such slot")
    while True:
        left, right = divmod(place, b)
        for p, q in _keys(seed)[::-1]:
            right = (right - _hash(q, left) % b) % b
            left = (left - _hash(p, right) % a) % a
        place = left * b + right
        if place < n:
            return place


def assign_shards(
    rows: DataFrame, order: list[str], shards: int = 8, seed: int = SEED
) -> DataFrame:
    """Add ``row_number`` (from 0, in the order of ``order``), ``shard`` and ``slot``.

    Every row gets a slot: nulls in the order columns come first, rows equal in
    all order columns are numbered in any order among themselves, an empty table
    stays empty. Columns of ``rows`` that have one of the three names are replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    kept = [c for c in rows.columns if c not in ("row_number", "shard", "slot")]
    keys = [f"key{i}" for i in range(len(order))]
    packed = rows.select(
        F.struct(*[F.col(c) for c in kept]).alias("row"),
        *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)],
    )
    numbered = dense_ids(packed, keys, name="row_number", start=0)
    n = numbered.count()  # one number, from the footers of the pinned rows
    placed = numbered.withColumn("place", permuted(F.col("row_number"), n, seed))
    return placed.select(
        "row.*",
        "row_number",
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.call_function("div", F.col("place"), F.lit(shards).cast("long")).alias("slot"),
    )


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """Size, checksum, shard and slot of each document, numbered by ``doc_id``.

    Only ids and numbers are shuffled, never texts. A null text has no bytes;
    equal or null ids are told apart by checksum and size where they differ.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return assign_shards(sized, ["doc_id", "text_crc32", "size"], shards, seed)
