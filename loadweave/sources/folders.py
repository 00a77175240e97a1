"""Folders on any file system that Spark can write to."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def subfolders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders directly below ``folder``; none where it does not exist."""
    files, path = _path(spark, folder)
    if not files.exists(path):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(path) if s.isDirectory())


def remove(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete folders with all that is in them; one that is gone already is no error."""
    for folder in folders:
        files, path = _path(spark, folder)
        files.delete(path, True)
