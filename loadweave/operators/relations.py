"""Requests and their files: joins, orphans, cascades, overwritten paths.

One request, or one path, may own a large share of all files. Joins here keep
the side that can be hot on the left of an inner, semi or anti join with plain
shuffles on both sides, which is the shape adaptive execution can split. Where
only the keys of that side matter, they are reduced before the shuffle instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.functions.ordered import running_total


def join_aggregated(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with an aggregate of them on ``key``, safe for hot keys.

    Adaptive execution splits a hot key only where a shuffle sits directly below
    each join side. An aggregate is already shuffled by its key and would join as
    it is; a hash of the key as second join column asks for a shuffle of its own,
    which moves no more than the aggregated rows.
    """
    check = {"_check": F.xxhash64(key)}
    return many.withColumns(check).join(one.withColumns(check), [key, "_check"]).drop("_check")


def request_with_files(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Every request with the number and bytes of its files, 0 where it has none."""
    per_request = files.groupBy(F.col("request_id").alias("id")).agg(
        F.count("*").alias("files"), F.sum("file_size").alias("bytes")
    )
    zero = F.lit(0).cast("long")
    return requests.join(per_request, "id", "left").withColumns(
        {"files": F.coalesce("files", zero), "bytes": F.coalesce("bytes", zero)}
    )


def file_pages(
    files: DataFrame, page_size: int, *columns: str, by: str = "request_id"
) -> DataFrame:
    """``by``, page, files: nested file lists of at most ``page_size`` entries.

    Pages are cut by position within the group, in id order, so a group has as many as
    it needs. Positions come from a running count over ranges: a group of any size is
    spread over many tasks.
    """
    one = F.lit(1).cast("long")
    narrow = files.select(by, "id", *columns, one.alias("_one"))
    placed = running_total(narrow, [by], ["id"], "_one", "_place")
    page = F.expr(f"(_place - 1) div {int(page_size)}L")
    return placed.groupBy(by, page.alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("id", *columns))).alias("files")
    )


def request_file_lists(requests: DataFrame, files: DataFrame, page_size: int = 1000) -> DataFrame:
    """Requests with nested file pages; a request without files has one empty page."""
    pages = file_pages(files, page_size, "file_type", "original_name", "file_size")
    none = F.array().cast(pages.schema["files"].dataType)
    return (
        requests.withColumnRenamed("id", "request_id")
        .join(pages, "request_id", "left")
        .withColumns(
            {
                "page": F.coalesce("page", F.lit(0).cast("long")),
                "files": F.coalesce("files", none),
            }
        )
    )


def fk_orphans(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Files whose request does not exist."""
    parents = requests.select(F.col("id").alias("request_id"))
    return files.join(parents, "request_id", "left_anti")


def cascade_delete(
    requests: DataFrame, files: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests kept, files kept, files removed) after deleting the ids in ``doomed``."""
    ids = doomed.select("id")
    as_parent = ids.withColumnRenamed("id", "request_id")
    return (
        requests.join(ids, "id", "left_anti"),
        files.join(as_parent, "request_id", "left_anti"),
        files.join(as_parent, "request_id", "left_semi"),
    )


def colliding_paths(files: DataFrame) -> DataFrame:
    """Paths written more than once: writers and the id whose bytes are on disk."""
    return (
        files.groupBy("file_path")
        .agg(F.count("*").alias("writers"), F.max("id").alias("kept_id"))
        .filter(F.col("writers") > 1)
    )


def path_collisions(files: DataFrame) -> DataFrame:
    """File rows whose bytes a later row with the same path has overwritten.

    The last writer per path is an aggregate, combined before the shuffle, so a
    path with very many writers is never sorted in one task.
    """
    collided = colliding_paths(files)
    return join_aggregated(files, collided, "file_path").filter(F.col("id") < F.col("kept_id"))
