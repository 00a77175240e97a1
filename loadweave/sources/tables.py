"""Parquet tables in a layout that serves the declared lookups.

Lookups go by id, request_id, mobile and status. Status becomes a partition
column; ids are served by sorted files whose min/max statistics let the scan skip
them, mobile by a bloom filter. Rows are split into ranges before the write, so
a status or request that owns most rows is still written by many tasks and each
task writes few files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave.session import pin
from loadweave.sources import folders


def write_requests(
    df: DataFrame, path: str, mode: str = "errorifexists", bloom_values: int = 1_000_000
) -> None:
    """Requests by status, sorted by id, with a bloom filter on mobile.

    ``bloom_values`` is the number of distinct mobiles to expect per file.
    """
    _requests_writer(df, bloom_values).mode(mode).parquet(path)


def _requests_writer(df: DataFrame, bloom_values: int = 1_000_000) -> DataFrameWriter:
    return (
        df.repartitionByRange("status", "id")
        .sortWithinPartitions("status", "id")
        .write.partitionBy("status")
        .option("parquet.bloom.filter.enabled#mobile", "true")
        .option("parquet.bloom.filter.expected.ndv#mobile", str(bloom_values))
    )


def write_request_files(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """File rows by file type, sorted by request."""
    _request_files_writer(df).mode(mode).parquet(path)


def _request_files_writer(df: DataFrame) -> DataFrameWriter:
    return (
        df.repartitionByRange("file_type", "request_id", "id")
        .sortWithinPartitions("file_type", "request_id", "id")
        .write.partitionBy("file_type")
    )


def by_mobile(spark: SparkSession, path: str, mobile: str) -> DataFrame:
    """Requests of one mobile, from the layout of ``write_requests``.

    The filter reaches the row groups: those whose bloom filter or dictionary does not have the value are not
    read. Mobiles follow no order in the files, so their smallest and largest values rule out nothing.
    """
    return spark.read.parquet(path).filter(F.col("mobile") == mobile)


def delete_requests(
    spark: SparkSession, requests_path: str, files_path: str, doomed: DataFrame, bloom_values: int = 1_000_000
) -> None:
    """Delete the requests with an id in ``doomed``, and their files, from the stored tables.

    Both are in the layouts above. Only partitions that hold a doomed row are read whole and
    written anew; all others keep their files. Files go first, so that no file is ever
    without its request. Repeating a delete that has broken off completes it.
    """
    ids = doomed.select("id").distinct()
    _rewrite_without(
        spark, files_path, ids.withColumnRenamed("id", "request_id"), "request_id", _request_files_writer
    )
    _rewrite_without(spark, requests_path, ids, "id", lambda df: _requests_writer(df, bloom_values))


def _rewrite_without(
    spark: SparkSession, path: str, gone: DataFrame, key: str, writer: Callable[[DataFrame], DataFrameWriter]
) -> None:
    # the source gives the path as a URI
    folder = F.regexp_replace(F.regexp_replace("_metadata.file_path", "/[^/]*$", ""), r"\+", "%2B")
    folder = F.url_decode(folder)
    stored = spark.read.parquet(path)
    hit = stored.select(key, folder.alias("_folder")).join(gone, key, "left_semi")
    # one name per partition of the table
    touched = [r[0] for r in hit.select("_folder").distinct().collect()]
    if not touched:
        return
    part = spark.read.schema(stored.schema).option("basePath", path).parquet(*touched)
    # written down before the old files go: what is read here must not be what is replaced
    left = pin(part.withColumn("_folder", folder).join(gone, key, "left_anti"))
    kept = {r[0] for r in left.select("_folder").distinct().collect()}
    rows = left.drop("_folder").select(*stored.columns)
    writer(rows).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    # a partition that has lost all its rows is not among those overwritten
    folders.remove(spark, [f for f in touched if f not in kept])


def write_bucketed(
    df: DataFrame, table: str, key: str, buckets: int, sort: Sequence[str], path: str | None = None
) -> None:
    """A catalogue table bucketed on ``key``, so joins on it need no shuffle.

    The write is split by bucket and then by ``sort``, so that a bucket with a hot
    key is written by several tasks. It is still read by one task per bucket: use
    the range layouts above for keys that may be hot.
    """
    bucket = F.pmod(F.hash(key), F.lit(buckets))
    writer = df.repartitionByRange(bucket, *sort).write.bucketBy(buckets, key).sortBy(*sort)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def append_batch(df: DataFrame, path: str, batch_id: int | str, by: Sequence[str] = ()) -> None:
    """Append ``df`` as one batch of a table; repeating a batch replaces it.

    A write that is retried after a failure therefore never doubles rows. Readers
    see the batch as a column.
    """
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(f"{path}/batch={batch_id}")


def append_run(log: DataFrame, path: str) -> None:
    """Add a run to the run log; repeating a run replaces its entry."""
    (
        log.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)
