"""Short codes for vectors: one codebook per part, learnt with LAESA pivots.

Components x become integers floor(4096 * x). A vector is cut into ``parts`` equal consecutive
parts; the codebook of each starts as that part of the ``codes`` first rows by vec_id. Each
round assigns every part to the nearest entry (squared Euclidean distance, ties to the
lower index) and replaces each used entry by the rounded-down mean of its parts.

LAESA: the distances of every part to a few fixed pivots, initial entries that lie far apart,
are computed once and pinned with the vectors. A round needs only the pivots' distances to
the current entries: the largest difference of the two distances over the pivots is a lower
bound of the distance of part and entry. Entries are tried in the order of their bounds, with
exact whole numbers, until the next bound lies above the best distance found. Bounds are
lowered by more than rounding can raise them, so no nearest entry is lost.

Per round each task sends one sum per entry and position, whatever its number of rows. The
driver sees those totals, parts x codes x (part length + 1) numbers, and no vectors.

Rows whose vector is null, or holds null, NaN or infinity, are dropped. Rows with one vec_id
all count; among the first ones they are ordered by their vectors, and null ids come last.
With fewer rows than codes there are fewer entries. Vectors of unequal lengths, lengths that
the parts do not divide, and components whose squares do not fit a long are errors.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave.operators.relations import join_aggregated
from loadweave.session import pin

PARTS = 8
CODES = 16
ROUNDS = 6
PIVOTS = 4
SCALE = 4096
_ROWS_AT_ONCE = 4096
# of distances stored with 24 bits, far above what rounding can do
_ROUNDING = 4e-7


def _integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors.astype(np.float64) * SCALE).astype(np.int64)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The squared distances of all rows of ``a`` from all rows of ``b``."""
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


def far_apart(entries: np.ndarray, pivots: int) -> np.ndarray:
    """Some of the entries, each the one farthest from those chosen before it."""
    chosen = [0]
    nearest = _squares(entries, entries[:1])[:, 0]
    while len(chosen) < min(pivots, len(entries)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _squares(entries, entries[chosen[-1:]])[:, 0])
    return entries[chosen]


def nearest(
    parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """For each part the index of the nearest entry and the squared distance; evaluations made."""
    between = np.sqrt(_squares(entries, pivots))
    low = np.zeros((len(parts), len(entries)))
    for k in range(len(pivots)):
        one, other = to_pivots[:, k, None].astype(np.float64), between[None, :, k]
        np.maximum(low, np.abs(one - other) - _ROUNDING * (one + other), out=low)
    order = np.argsort(low, axis=1, kind="stable")
    low = np.take_along_axis(low, order, axis=1) ** 2
    best = np.full(len(parts), np.iinfo(np.int64).max)
    code = np.zeros(len(parts), np.int64)
    rows, made = np.arange(len(parts)), 0
    for turn in range(len(entries)):
        rows = rows[low[rows, turn] <= best[rows]]
        if not len(rows):
            break
        entry = order[rows, turn]
        exact = ((parts[rows] - entries[entry]) ** 2).sum(axis=1)
        made += len(rows)
        nearer = (exact < best[rows]) | (exact == best[rows]) & (entry < code[rows])
        best[rows[nearer]] = exact[nearer]
        code[rows[nearer]] = entry[nearer]
    return code, best, made


class Codebooks:
    """The entries of all parts: an array by part, entry and position; and the fixed pivots."""

    def __init__(self, entries: np.ndarray, pivots: list[np.ndarray]):
        self.entries, self.pivots = entries, pivots

    def moved(self, totals) -> Codebooks:
        """The entries after a round, from rows (part, entry, position or -1, total)."""
        count = np.zeros(self.entries.shape[:2], np.int64)
        sums = np.zeros_like(self.entries)
        for part, entry, at, total in totals:
            if at < 0:
                count[part, entry] = total
            else:
                sums[part, entry, at] = total
        means = sums // np.maximum(count, 1)[:, :, None]
        return Codebooks(np.where(count[:, :, None] > 0, means, self.entries), self.pivots)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _measured(pivots: list[np.ndarray]):
    """Integer vectors and the distances of their parts to the pivots."""
    count, length = len(pivots), pivots[0].shape[1]

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), _ROWS_AT_ONCE):
                rows = batch.slice(a, _ROWS_AT_ONCE)
                vectors = rows.column("embedding").flatten().to_numpy(zero_copy_only=False)
                vectors = _integers(vectors).reshape(len(rows), count * length)
                to = [
                    np.sqrt(_squares(vectors[:, p * length : (p + 1) * length], x)).astype(np.float32)
                    for p, x in enumerate(pivots)
                ]
                to = np.concatenate(to, axis=1)
                lists = [
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(rows) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())
                    )
                    for x in (vectors.astype(np.int32), to)
                ]
                yield pa.record_batch(
                    [rows.column("vec_id"), rows.column("label"), *lists],
                    names=["vec_id", "label", "v", "d"],
                )

    return run


def _assigned(books: Codebooks):
    """Yields (rows of the batch, codes, squared distances) of arrays of rows x parts."""
    count, _, length = books.entries.shape
    pivots = books.pivots[0].shape[0]

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), _ROWS_AT_ONCE):
                rows = batch.slice(a, _ROWS_AT_ONCE)
                v = rows.column("v").flatten().to_numpy(zero_copy_only=False)
                v = v.astype(np.int64).reshape(len(rows), count, length)
                d = rows.column("d").flatten().to_numpy(zero_copy_only=False)
                d = d.reshape(len(rows), count, pivots)
                found = [nearest(v[:, p], d[:, p], books.entries[p], books.pivots[p]) for p in range(count)]
                yield rows, v, *(np.stack([f[k] for f in found], axis=1) for k in (0, 1))

    return run


def _sums(books: Codebooks):
    """part, entry, at (-1: how many), total: one row for each, per task."""
    count, codes, length = books.entries.shape

    def run(batches):
        sums = np.zeros((count * codes, length + 1), np.int64)
        for _, v, code, _ in _assigned(books)(batches):
            for p in range(count):
                place = p * codes + code[:, p]
                many = np.bincount(place, minlength=count * codes)
                sums[:, 0] += many
                used = np.flatnonzero(many)
                order = np.argsort(place, kind="stable")
                first = (np.cumsum(many) - many)[used]
                sums[used, 1:] += np.add.reduceat(v[order, p], first, axis=0)
        place, at = np.nonzero(sums)
        yield pa.record_batch(
            [pa.array(x) for x in (place // codes, place % codes, at - 1, sums[place, at])],
            names=["part", "entry", "at", "total"],
        )

    return run


def _coded(books: Codebooks):
    count = len(books.entries)

    def run(batches):
        for rows, _, code, error in _assigned(books)(batches):
            digits = code.astype(np.uint8).tobytes().hex()
            text = [digits[a : a + 2 * count] for a in range(0, len(digits), 2 * count)]
            yield pa.record_batch(
                [rows.column("vec_id"), rows.column("label"), pa.array(text, pa.string()), pa.array(error.sum(axis=1))],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def _kept(vectors: DataFrame) -> DataFrame:
    whole = F.forall(
        "embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    )
    # a null vector gives null, and no row
    return vectors.select("vec_id", "label", "embedding").filter(whole)


def _check(kept: DataFrame, parts: int) -> int:
    """The length of all vectors; 0 without any."""
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    low, high, most = kept.agg(
        F.min(F.size("embedding")), F.max(F.size("embedding")), F.max(F.coalesce(most, F.lit(0.0)))
    ).first()
    if low is None:
        return 0
    if low != high or low % parts:
        raise ValueError(f"vectors have {low} to {high} components; {parts} equal parts are asked for")
    if low and most >= isqrt(((1 << 63) - 1) // low) // 2 // SCALE:
        raise ValueError(f"the squares of components up to {most} do not fit a long")
    return low


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, codes: int = CODES, rounds: int = ROUNDS, pivots: int = PIVOTS
) -> DataFrame:
    """vec_id, code (two hex digits per part), error, label_error, codebooks_sha256.

    ``error`` is the sum over parts of the squared distances to the entries; ``label_error`` that
    over all rows with the same label, null labels together.
    """
    if codes > 256:
        raise ValueError("two hex digits hold 256 codes")
    kept = _kept(vectors)
    kinds = {f.name: f.dataType for f in kept.schema}
    ids = [T.StructField(c, kinds[c]) for c in ("vec_id", "label")]
    length = _check(kept, parts)
    # the first rows only, as many as there are codes
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(codes).select("embedding").collect()
    if not first:
        return kept.filter(F.lit(False)).select(
            "vec_id",
            F.lit("").alias("code"),
            *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")],
            F.lit("").alias("codebooks_sha256"),
        )
    seeds = _integers(np.array([r.embedding for r in first], np.float64)).reshape(len(first), parts, length // parts)
    entries = np.ascontiguousarray(seeds.transpose(1, 0, 2))
    books = Codebooks(entries, [far_apart(e, pivots) for e in entries])

    given = T.StructType(
        [*ids, T.StructField("v", T.ArrayType(T.IntegerType())), T.StructField("d", T.ArrayType(T.FloatType()))]
    )
    measured = pin(kept.mapInArrow(_measured(books.pivots), given))
    for _ in range(rounds):
        sums = measured.mapInArrow(_sums(books), "part long, entry long, at long, total long")
        books = books.moved(sums.groupBy("part", "entry", "at").agg(F.sum("total")).collect())

    out = T.StructType([*ids, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = pin(measured.mapInArrow(_coded(books), out))
    # a struct of a null label equals another one
    coded = coded.withColumn("_label", F.struct("label"))
    per_label = coded.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return join_aggregated(coded, per_label, "_label").select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )
