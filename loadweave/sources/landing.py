"""Landing folders: form submissions as JSON lines, uploaded files as bytes."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave import schemas
from loadweave.functions import names


_KEEP_BROKEN = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": schemas.RAW_TEXT}


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Landed form submissions, with the declared schema rather than an inferred one.

    A line that cannot be read becomes a row with nothing but its text.
    """
    return spark.read.schema(schemas.LANDED).options(**_KEEP_BROKEN).json(path)


def parse_submissions(df: DataFrame, column: Column | str, *keep: str) -> DataFrame:
    """Submissions from a column of JSON texts, next to the kept columns.

    The parsed fields come out as a generated row. As plain fields of a parsed
    struct they would be inlined into later filters, each of them parsing again.
    """
    parsed = F.from_json(column, schemas.LANDED, _KEEP_BROKEN)
    return df.select(*keep, F.inline(F.array(parsed)))


# as the source for whole files declares it
BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def parse_manifest(landed: DataFrame, *keep: str) -> DataFrame:
    """Manifest rows for landed files given as path and size, next to the kept columns.

    path, size, request_id, layout, file_type, original_name; both path layouts are
    recognised, anything else has layout ``unknown``.
    """
    return landed.select("path", "size", names.parsed_path("path").alias("p"), *keep).select(
        "path", "size", "p.*", *keep
    )


def binary_files(spark: SparkSession, root: str) -> DataFrame:
    """path, size, modified_at of the files below ``root``, without their bytes.

    This source leaves out files without content; ``list_folders`` keeps them.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    )


_LISTED = "path string, size bigint"
_AT_ONCE = 10_000


def _in_chunks(found: Iterator, columns: list[str]) -> Iterator[pd.DataFrame]:
    for part in iter(lambda: list(islice(found, _AT_ONCE)), []):
        yield pd.DataFrame(part, columns=columns)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names only of what lies directly in the root; a missing root is an error."""
    for batch in batches:
        for root in batch["root"]:
            with os.scandir(root) as entries:
                yield from _in_chunks(((root, e.path) for e in entries), ["root", "entry"])


def _files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def below(root, entry):
        if not os.path.isdir(root):
            raise FileNotFoundError(f"{root} is not mounted here")
        if os.path.isfile(entry):
            yield entry, os.path.getsize(entry)
        for folder, _, leaves in os.walk(entry):
            for leaf in leaves:
                path = os.path.join(folder, leaf)
                yield path, os.path.getsize(path)

    for batch in batches:
        for root, entry in zip(batch["root"], batch["entry"], strict=True):
            yield from _in_chunks(below(root, entry), ["path", "size"])


def list_folders(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """path, size of every file below ``root``, empty ones included.

    ``root`` is the upload folder on a path that all executors mount; it is an error
    if it is missing where a task runs. One task lists the names of the folders in it,
    whether or not a request owns them; they are spread over ``tasks``, each of which
    streams its entries out in chunks.
    """
    top = spark.createDataFrame([(root.rstrip("/"),)], "root string")
    folders = top.mapInPandas(_entries, "root string, entry string")
    spread = folders.repartition(tasks, "entry") if tasks else folders.repartition("entry")
    return spread.mapInPandas(_files, _LISTED)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write ``content`` (text; NULL is empty) to ``path`` below ``root``: path and size of each.

    Lazy: files are written where the outcome is computed. A repeated write gives the
    same file.
    """

    def write(batches):
        for batch in batches:
            sizes = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                target = os.path.join(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                data = (content or "").encode()
                with open(target, "wb") as out:
                    out.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"path": batch["path"], "size": sizes})

    return files.select("path", "content").mapInPandas(write, _LISTED)
