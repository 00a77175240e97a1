"""Ordered scans that no single group can overload.

``Window.partitionBy(group)`` puts a whole group into one task. The functions
here first split the rows into ranges of the sort key, so a group of any size
is spread over many tasks; what earlier ranges contribute to a later one is
worked out on one summary row per range and enters that range as its first row.
The sort key, with the grouping columns, must be unique per row: then ranges
can be cut anywhere and the outcome does not depend on where.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadweave.session import pin

RANGE = "_range"
_LEAD = "_lead"


def split_ranges(df: DataFrame, keys: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Split on the sort key and number the ranges in ``_range``.

    Range bounds come from a sample, so the split is pinned: every later use
    sees the same ranges. Without ``ranges`` the session's shuffle partition
    count applies, lowered at run time where the data is small.
    """
    split = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    return pin(split.withColumn(RANGE, F.spark_partition_id()))


def _earlier_ranges(by: Sequence[str]):
    # one row per group and range: at most as many rows as there are ranges
    return Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def range_offsets(ranges: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per group and range: the total of ``value`` over all earlier ranges."""
    totals = ranges.groupBy(*by, RANGE).agg(F.sum(value).alias("_total"))
    before = F.sum("_total").over(_earlier_ranges(by))
    return totals.select(*by, RANGE, F.coalesce(before, F.lit(0).cast("long")).alias(value))


def _so_far(by, order):
    window = Window.partitionBy(*by).orderBy(*order)
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _scan(ranges, leads, by, order, computed):
    """Window over each range with its lead row in front, lead rows removed after."""
    rows = ranges.withColumn(_LEAD, F.lit(False)).unionByName(
        leads.withColumn(_LEAD, F.lit(True)), allowMissingColumns=True
    )
    window = _so_far([*by, RANGE], [F.desc(_LEAD), *order])
    return rows.withColumns({n: make(window) for n, make in computed.items()}).filter(~F.col(_LEAD))


def running_total(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``name``: the total of the integer column ``value`` up to and with each row."""
    split = split_ranges(df, [*by, *order], ranges)
    return total_in_ranges(split, range_offsets(split, by, value), by, order, value, name)


def total_in_ranges(
    split: DataFrame,
    offsets: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
) -> DataFrame:
    """``running_total`` of rows already split, with the offsets of their ranges."""
    summed = _scan(split, offsets, by, order, {name: lambda w: F.sum(value).over(w)})
    return summed.drop(RANGE, _LEAD)


def carry_forward(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    ranges: int | None = None,
) -> DataFrame:
    """Replace each of ``columns`` by its last non-null value up to and with each row."""
    split = split_ranges(df, [*by, *order], ranges)
    at = F.struct(*order)
    ends = split.groupBy(*by, RANGE).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns]
    )
    earlier = _earlier_ranges(by)
    leads = ends.select(
        *by, RANGE, *[F.last(c, ignorenulls=True).over(earlier).alias(c) for c in columns]
    )
    last = {c: (lambda w, c=c: F.last(c, ignorenulls=True).over(w)) for c in columns}
    return _scan(split, leads, by, order, last).drop(RANGE, _LEAD)


def dense_ids(
    df: DataFrame,
    order: Sequence[str],
    name: str = "id",
    start: int = 1,
    ranges: int | None = None,
) -> DataFrame:
    """Add a gapless integer ``name`` that follows ``order``, counting from ``start``.

    The position inside a range comes from the row counter of its partition, so
    numbering needs no window over the rows and no shuffle beyond the range
    split. Only the range sizes, one row each, are summed up.
    """
    row_bits = 33  # low bits of the counter: position in the partition
    split = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    counted = pin(
        split.sortWithinPartitions(*order).withColumn("_counter", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("_counter", row_bits)
    place = F.col("_counter").bitwiseAND(F.lit((1 << row_bits) - 1))
    numbered = counted.withColumns({RANGE: part, "_place": place})
    sizes = numbered.groupBy(RANGE).agg((F.max("_place") + 1).alias("_size"))
    earlier = Window.partitionBy(F.lit(0)).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        RANGE, F.coalesce(F.sum("_size").over(earlier), F.lit(0).cast("long")).alias("_before")
    )
    # one row per range, so the copy sent to every executor is small by construction
    return numbered.join(F.broadcast(starts), RANGE).select(
        (F.col("_before") + F.col("_place") + F.lit(start)).alias(name), *df.columns
    )


def next_id(existing: DataFrame) -> int:
    """One more than the largest id; 1 for an empty table. Brings one number to the driver."""
    return existing.agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("m")).first()["m"] + 1
