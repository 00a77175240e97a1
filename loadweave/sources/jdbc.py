"""Tables of a relational store, read and written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession


def scan_options(
    url: str,
    table: str,
    lower: int,
    upper: int,
    partitions: int,
    key: str = "id",
    fetch_size: int = 10_000,
    **extra: str,
) -> dict[str, str]:
    """Options of a scan that is split on an integer key.

    The bounds place the cuts only: rows outside them are read too.
    """
    if partitions < 1 or upper <= lower:
        raise ValueError("need at least one partition and upper > lower")
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": key,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
        **extra,
    }


def jdbc_reader(spark: SparkSession, options: dict[str, str]) -> DataFrameReader:
    return spark.read.format("jdbc").options(**options)


def jdbc_scan(spark: SparkSession, url: str, table: str, *bounds: int, **extra) -> DataFrame:
    """One table; filters and the column list are handed to the store.

    ``bounds`` are lower, upper and the number of partitions.
    """
    return jdbc_reader(spark, scan_options(url, table, *bounds, **extra)).load()


def jdbc_append(
    df: DataFrame, url: str, table: str, partitions: int, batch_size: int = 10_000, **extra: str
) -> None:
    """Append rows over at most ``partitions`` connections, in batches."""
    writer = df.write.format("jdbc").mode("append").option("url", url).option("dbtable", table)
    options = {"numPartitions": str(partitions), "batchsize": str(batch_size), **extra}
    writer.options(**options).save()
