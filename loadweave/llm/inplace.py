"""Joins with the rows of a pinned table where they lie, without moving the rows.

A table that is numbered by ``monotonically_increasing_id`` and pinned has in each number
the partition the row was written from. What is to be joined, narrow rows with a number ``n``,
is written to files by that partition, sorted by number; the task that reads a part of the table
reads the numbers of that part. So texts move only where the join has a row for them, whatever
the sizes of the two sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave.llm.common import filesystem, fresh_folder

_PART_BITS = 33  # lower bits of the number: the row in its partition
_PARTS_A_FILE = 16


class _Numbered:
    """The rows for one partition of the table, read when it is met."""

    def __init__(self, folder: str, schema: pa.Schema):
        self.folder, self.schema, self.part, self.rows = folder, schema, None, None

    def of(self, part: int) -> pa.Table:
        if part != self.part:
            found, path = filesystem(f"{self.folder}/bucket={part // _PARTS_A_FILE}")
            if found.get_file_info(path).type == fs.FileType.NotFound:
                rows = self.schema.empty_table()
            else:
                low = part << _PART_BITS
                wanted = [("n", ">=", low), ("n", "<", low + (1 << _PART_BITS))]
                rows = pq.read_table(
                    path, filesystem=found, filters=wanted, columns=self.schema.names, partitioning=None
                )
                rows = rows.cast(self.schema).sort_by("n")
            self.part, self.rows = part, rows
        return self.rows


def _pieces(batch: pa.RecordBatch, numbered: _Numbered):
    """(rows of the batch, rows for their partition), split where the partition changes."""
    n = batch.column("n").to_numpy()
    part = n >> _PART_BITS
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(n)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a), numbered.of(int(part[a]))


def _written(numbers: DataFrame) -> _Numbered:
    folder = fresh_folder(numbers.sparkSession, "picked")
    bucket = F.shiftright("n", _PART_BITS).cast("long")
    (
        numbers.withColumn("bucket", F.floor(bucket / _PARTS_A_FILE).cast("long"))
        .repartition("bucket")
        .sortWithinPartitions("bucket", "n")
        .write.partitionBy("bucket")
        .parquet(folder)
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    return _Numbered(folder, to_arrow_schema(numbers.schema))


def without(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows whose ``n`` is not among ``numbers``."""
    numbered = _written(numbers.select("n"))

    def run(batches):
        for batch in batches:
            for piece, gone in _pieces(batch, numbered):
                gone, n = gone.column("n").to_numpy(), piece.column("n").to_numpy()
                at = np.minimum(np.searchsorted(gone, n), max(len(gone) - 1, 0))
                stays = gone[at] != n if len(gone) else np.ones(len(n), bool)
                if stays.any():
                    yield piece.filter(pa.array(stays))

    return rows.mapInArrow(run, rows.schema)


def joined(
    rows: DataFrame, numbers: DataFrame, column: str, name: str, make: Callable, at_once: int
) -> DataFrame:
    """``numbers``, each with ``name``: the bytes that ``make()`` makes of its row's ``column``.

    ``make`` is called once per task and gives a function. Several rows of ``numbers`` may have
    one ``n``. At most some ``at_once`` bytes leave a task at a time.
    """
    numbered = _written(numbers)
    schema = T.StructType([*numbers.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches):
        of = make()
        for batch in batches:
            for piece, wanted in _pieces(batch, numbered):
                n, asked = piece.column("n").to_numpy(), wanted.column("n").to_numpy()
                first, last = np.searchsorted(asked, n), np.searchsorted(asked, n, side="right")
                at, made, held = [], [], 0
                for k in np.flatnonzero(last > first).tolist():
                    value = of(piece.column(column)[k].as_py())
                    many = int(last[k] - first[k])
                    at.extend(range(first[k], last[k]))
                    made.extend([value] * many)
                    held += len(value) * many
                    if held > at_once:
                        yield from _with(wanted, at, name, made)
                        at, made, held = [], [], 0
                yield from _with(wanted, at, name, made)

    return rows.select("n", column).mapInArrow(run, schema)


def _with(rows: pa.Table, at: list[int], name: str, values: list[bytes]):
    if at:
        picked = rows.take(pa.array(at)).append_column(name, pa.array(values, pa.binary()))
        yield from picked.combine_chunks().to_batches()
