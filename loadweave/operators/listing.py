"""Request lists, pages and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_list(requests: DataFrame) -> DataFrame:
    """All requests, newest first: a range-partitioned sort, meant to be written out."""
    return requests.orderBy(F.desc("id"))


def request_page(requests: DataFrame, size: int, before_id: int | None = None) -> DataFrame:
    """The ``size`` newest requests older than ``before_id``; one screen of the list.

    The key filter reaches the scan, and each task keeps ``size`` rows only.
    """
    older = requests if before_id is None else requests.filter(F.col("id") < before_id)
    return older.orderBy(F.desc("id")).limit(size)


def request_lookup(requests: DataFrame, request_id: int) -> DataFrame:
    """The request with this id, or no row. The filter reaches the scan."""
    return requests.filter(F.col("id") == request_id).limit(1)


def request_lookup_many(requests: DataFrame, ids: DataFrame) -> DataFrame:
    """The requests whose id occurs in ``ids``."""
    return requests.join(ids.select("id"), "id", "left_semi")


def admin_view(requests: DataFrame) -> DataFrame:
    """id, company, status, newest first."""
    return request_list(requests.select("id", F.col("company_name").alias("company"), "status"))
