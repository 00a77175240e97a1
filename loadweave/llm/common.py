"""What several corpus operators need: tables, bound values, files in the shared folder."""

from __future__ import annotations

from uuid import uuid4

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.session import shared_folder

# ASCII letters only: other letters keep their case
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# words that ASCII white space separates, as a regular expression of Spark and of DuckDB
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it.

    A column used several times in a lambda may be computed anew for every
    element; the variable of a lambda never is.
    """
    return F.transform(F.array(value), body)[0]


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared path and the path in it; for use in tasks."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str:
    """The path under which tasks can memory-map a shared file."""
    found, path = filesystem(uri)
    if not isinstance(found, fs.LocalFileSystem):
        raise ValueError(f"memory mapping needs a mounted shared folder, not {uri}")
    return path
