"""Streams that give what their batch twins give.

Each stream writes batches to a table in a folder, keyed by the batch id, so a
batch that is repeated after a failure replaces itself. ``continuous`` uses the
refresh interval; otherwise a stream takes what has landed and stops.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loadweave import fixed_values as fv
from loadweave import schemas
from loadweave.functions import names
from loadweave.functions.ordered import next_id
from loadweave.operators.intake import check_submissions, content_hash, has_key, intake, numbered
from loadweave.operators.quality import REASONS
from loadweave.operators.reports import kpis_with
from loadweave.sources import folders
from loadweave.sources.landing import BINARY_FILE, parse_manifest
from loadweave.sources.tables import append_batch


def file_feed(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    source: str = "parquet",
    name_filter: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Rows of the files that land below ``path``, each file once."""
    reader = spark.readStream.format(source).schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if source == "binaryFile":
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(path)


def _start(df, checkpoint, mode, handle, continuous) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": fv.STATUS_REFRESH} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).foreachBatch(handle).start()


def _log(folder: str, fold: Callable[[DataFrame], DataFrame], every: int, keep: int):
    """A batch handler that logs each batch and folds the log every ``every`` batches.

    ``batches`` holds what each batch brought, ``state`` what all batches up to one come
    to. A repeated batch replaces itself in both. Behind the last ``keep`` folds
    both are removed, so that the folders to list stay as few as ``every * (keep + 1)``; a reader
    that has listed them before has that many batches of time to read.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, f"{folder}/batches", batch_id)
        if (batch_id + 1) % every == 0:
            spark = batch.sparkSession
            folded = fold(_read_log(spark, folder, batch_id))
            folded.write.mode("overwrite").parquet(f"{folder}/state/upto={batch_id}")
            folds = [n for n in _numbers(spark, f"{folder}/state") if n <= batch_id]
            if len(folds) > keep:
                _remove_behind(spark, folder, folds[-keep - 1])

    return handle


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the folders ``name=number``, in order; as many as are kept."""
    return sorted(int(name.partition("=")[2]) for name in folders.subfolders(spark, folder) if "=" in name)


def _remove_behind(spark: SparkSession, folder: str, upto: int) -> None:
    """What the state after ``upto`` has taken in: the batches up to it and older states."""
    old = [f"{folder}/batches/batch={n}" for n in _numbers(spark, f"{folder}/batches") if n <= upto]
    old += [f"{folder}/state/upto={n}" for n in _numbers(spark, f"{folder}/state") if n <= upto]
    folders.remove(spark, old)


def _read_log(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The newest state and the batches after it.

    ``before``: only a state older than that batch, for the batch that writes the next one.
    """
    log = spark.read.parquet(f"{folder}/batches")
    upto = [n for n in _numbers(spark, f"{folder}/state") if before is None or n < before]
    if not upto:
        return log
    states = spark.read.parquet(f"{folder}/state")
    state = states.filter(F.col("upto") == upto[-1]).withColumnRenamed("upto", "batch")
    return state.unionByName(log.filter(F.col("batch") > upto[-1]), allowMissingColumns=True)


def start_latest_status(
    feed: DataFrame,
    folder: str,
    checkpoint: str,
    continuous: bool = False,
    compact_every: int = 100,
    keep_folds: int = 2,
) -> StreamingQuery:
    """Keep the last status per id of a feed of id, status, ts, event_id.

    Every batch writes the ids it changed, with the event that decided it. Every
    ``compact_every`` batches the log is folded, so that reading it costs the ids and
    a bounded number of batches, however long the stream runs; what lies behind the last
    ``keep_folds`` folds is removed.
    """
    last = feed.groupBy("id").agg(
        F.max_by(F.struct("status", "ts", "event_id"), F.struct("ts", "event_id")).alias("last")
    )
    handle = _log(folder, _last_per_id, compact_every, keep_folds)
    return _start(last.select("id", "last.*"), checkpoint, "update", handle, continuous)


def _last_per_id(log: DataFrame) -> DataFrame:
    turn = F.struct("ts", "event_id")
    last = log.groupBy("id").agg(
        F.max_by(F.struct("status", "ts", "event_id"), turn).alias("last")
    )
    return last.select("id", "last.*")


def read_latest_status(spark: SparkSession, folder: str) -> DataFrame:
    """id, status, css_class as of the last finished batch."""
    last = _last_per_id(_read_log(spark, folder)).select("id", "status")
    return last.withColumn("css_class", names.status_class("status"))


_NEXT = ("request_id", "file_id")
_ACCEPTED = "accepted"
_REJECTED = T.StructField(REASONS, T.ArrayType(T.StringType()))
# what the stream of submissions writes; a table is without files as long as it has no rows
SUBMISSION_TABLES = {
    "requests": schemas.REQUESTS,
    "files": schemas.REQUEST_FILES,
    "rejected": T.StructType([*schemas.LANDED.fields, _REJECTED]),
    "rejected_files": T.StructType([*schemas.REQUEST_FILES.fields, _REJECTED]),
}


def start_submissions(
    feed: DataFrame,
    now: Callable[[], datetime],
    folder: str,
    checkpoint: str,
    run: str = "",
    continuous: bool = False,
) -> StreamingQuery:
    """Turn landed submissions into requests, files and rejects, with the batch intake.

    ``feed`` has the submission columns. No row is late and none is lost: each lands in
    ``requests``, in ``rejected``, or is an exact repeat of a row before it. What was
    there before is keyed state of the stream, in its checkpoint; no table is read for it:

    - id and content of each row, so that an exact repeat is dropped however late it comes;
    - the ids of which a copy has passed the checks. A rejected submission that lands
      again corrected is taken; a copy that passes but differs from the one taken is a reject.

    Every batch also writes the next free ids, so it reads one row of the batch before, and a
    repeated batch gets the ids it had. The state grows with the rows, 8 bytes of content each.
    """
    content = "_content"
    rows = feed.withColumn(content, content_hash(feed.columns))
    keyed = rows.filter(has_key())
    once = keyed.dropDuplicates(["submission_id", content]).unionByName(rows.filter(~has_key()))
    passed = check_submissions(keyed).filter(F.size(REASONS) == 0)
    new = passed.select("submission_id").dropDuplicates(["submission_id"])
    marked = once.drop(content).withColumn(_ACCEPTED, F.lit(False)).unionByName(
        new.withColumn(_ACCEPTED, F.lit(True)), allowMissingColumns=True
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # the intake reads its input several times: texts are parsed once, into a table
        table = numbered(batch)
        append_batch(table, f"{folder}/landed", batch_id, [_ACCEPTED])
        written = spark.read.schema(table.schema).parquet(f"{folder}/landed/batch={batch_id}")
        landed = written.filter(~F.col(_ACCEPTED)).drop(_ACCEPTED)
        fresh = written.filter(_ACCEPTED).select("submission_id")
        start = dict.fromkeys(_NEXT, 1)
        if batch_id > 0:
            start = spark.read.parquet(f"{folder}/next_ids/batch={batch_id - 1}").first().asDict()
        requests, files, rejected, bad_files = intake(
            landed, now(), start["request_id"], start["file_id"], run, fresh
        )
        append_batch(requests, f"{folder}/requests", batch_id, ["status"])
        append_batch(files, f"{folder}/files", batch_id, ["file_type"])
        append_batch(rejected, f"{folder}/rejected", batch_id)
        append_batch(bad_files, f"{folder}/rejected_files", batch_id)
        # files that fail a check have used up their ids as well
        free = {
            "request_id": _after(spark, start["request_id"], batch_id, f"{folder}/requests"),
            "file_id": _after(
                spark, start["file_id"], batch_id, f"{folder}/files", f"{folder}/rejected_files"
            ),
        }
        schema = ", ".join(f"{c} long" for c in _NEXT)
        append_batch(
            spark.createDataFrame([tuple(free[c] for c in _NEXT)], schema).coalesce(1),
            f"{folder}/next_ids",
            batch_id,
        )

    return _start(marked, checkpoint, "append", handle, continuous)


def read_submissions(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of ``SUBMISSION_TABLES`` as of the last finished batch, with the batch of each row."""
    schema = SUBMISSION_TABLES[table]
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(
        f"{folder}/{table}"
    )


def _after(spark: SparkSession, start: int, batch_id: int, *tables: str) -> int:
    """First id that a batch has left free."""
    read = spark.read.schema("id bigint")
    return max(start, *[next_id(read.parquet(f"{t}/batch={batch_id}")) for t in tables])


def start_intake(
    files: DataFrame,
    load_requests: Callable[[], DataFrame],
    folder: str,
    checkpoint: str,
    continuous: bool = False,
) -> StreamingQuery:
    """Take in file rows once each, marked by whether their request is ``known``.

    ``files`` has id, request_id and file_type. A row whose id was taken before, in this
    batch or any earlier one, is a repeat: ids are keyed state of the stream, exact for ever, and no
    batch reads a table of them. Rows without id all stay. No row is late. The
    requests are loaded again for every batch; for files that may come before their request
    see ``start_waiting_files``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        parents = load_requests().select(F.col("id").alias("request_id"), F.lit(True).alias("known"))
        marked = batch.join(parents, "request_id", "left").withColumn(
            "known", F.coalesce("known", F.lit(False))
        )
        append_batch(marked, folder, batch_id, ["known", "file_type"])

    return _start(_once(files), checkpoint, "append", handle, continuous)


def _once(files: DataFrame) -> DataFrame:
    """Rows of one id once over the life of the stream; rows without id all stay."""
    return files.filter(F.col("id").isNotNull()).dropDuplicates(["id"]).unionByName(
        files.filter(F.col("id").isNull())
    )


ARRIVED = "arrived_at"


def arriving(df: DataFrame) -> DataFrame:
    """A stream's rows with the time of the batch that brings them. By it no row is late."""
    return df.withColumn(ARRIVED, F.current_timestamp())


def start_waiting_files(
    files: DataFrame,
    requests: DataFrame,
    wait: timedelta,
    folder: str,
    checkpoint: str,
    delay: timedelta = timedelta(0),
    continuous: bool = False,
) -> StreamingQuery:
    """Take in file rows once each, when their request has come or has not within ``wait``.

    Both are streams: ``files`` has id, request_id, file_type and arrived_at, ``requests`` id
    (unique) and arrived_at. Bytes are stored before anything is known of their request, so a file may be
    the first to arrive. It waits in the state of a left outer join: it is ``known`` in the batch
    that brings its request, and an orphan once the watermark has passed its arrival by ``wait``
    without one. Files of a request that came before are known at once, however old that is: the
    state keeps the id and arrival of every request.

    The watermark is the smaller one of both streams, so an orphan shows only after both have brought
    something later. Rows older than the watermark less ``delay`` would be lost in the join: with the
    times of ``arriving`` there are none; with times of the rows' own the delay has to cover the disorder.
    """
    seconds = f"{delay.total_seconds():.6f} seconds"
    left = _once(files.withWatermark(ARRIVED, seconds))
    right = requests.withWatermark(ARRIVED, seconds).select(
        F.col("id").alias("_request"), F.col(ARRIVED).alias("_arrived")
    )
    waited = F.col(ARRIVED) + F.expr(f"interval '{wait.total_seconds():.6f}' second")
    met = left.join(
        right, (F.col("request_id") == F.col("_request")) & (F.col("_arrived") <= waited), "left_outer"
    )
    marked = met.withColumn("known", F.col("_request").isNotNull()).drop("_request", "_arrived")

    def handle(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, folder, batch_id, ["known", "file_type"])

    return _start(marked, checkpoint, "append", handle, continuous)


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_LISTING_A_CORE = 4


def _few_listing_tasks(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark``, but for the number of tasks that list folders.

    By itself Spark takes a task for each folder, up to 10,000, and each sends kilobytes to the
    driver besides some bytes a file. A stream lists whenever it looks for files, by the setting that its
    session has then, so it gets a session of its own.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    few = _LISTING_A_CORE * max(1, spark.sparkContext.defaultParallelism)
    own.conf.set(_LISTING, str(min(few, int(spark.conf.get(_LISTING)))))
    return own


def manifest_feed(
    spark: SparkSession, root: str, files_per_batch: int | None = None, name_filter: str | None = None
) -> DataFrame:
    """Manifest rows of the files that land below ``root``, each path once, with modified_at.

    Only path, length and time of a file are read, not its bytes. This source leaves out files
    without content, as ``landing.binary_files`` does. Folders are listed by some tasks a core.
    """
    feed = file_feed(_few_listing_tasks(spark), root, BINARY_FILE, "binaryFile", name_filter, files_per_batch)
    landed = feed.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    return parse_manifest(landed, "modified_at")


def start_manifest(feed: DataFrame, folder: str, checkpoint: str, continuous: bool = False) -> StreamingQuery:
    """Keep the manifest of the landed files, a part for each batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, folder, batch_id)

    return _start(feed, checkpoint, "append", handle, continuous)


def read_intake(spark: SparkSession, folder: str, known: bool | None = None) -> DataFrame:
    """File rows taken in so far: all with their mark, or those with, or without, a request.

    Of ``start_waiting_files``, files that still wait are neither.
    """
    rows = spark.read.parquet(folder).drop("batch").withColumn("known", F.col("known").cast("boolean"))
    return rows if known is None else rows.filter(F.col("known") == known).drop("known")


def start_kpis(
    orders: DataFrame,
    ready_status: str,
    folder: str,
    checkpoint: str,
    company: str = "company",
    status: str = "status",
    continuous: bool = False,
    compact_every: int = 100,
    keep_folds: int = 2,
) -> StreamingQuery:
    """Keep order counts per company; the dashboard counts are read off them.

    Counting per company keeps the number of companies exact: the state grows with
    the companies, not with the orders. The log is folded as for the latest status.
    """
    counts = orders.groupBy(F.col(company).alias("company")).agg(
        F.count("*").alias("orders"), F.count_if(F.col(status) == ready_status).alias("ready")
    )
    handle = _log(folder, _last_per_company, compact_every, keep_folds)
    return _start(counts, checkpoint, "update", handle, continuous)


def _last_per_company(log: DataFrame) -> DataFrame:
    last = log.groupBy("company").agg(
        F.max_by(F.struct("orders", "ready"), "batch").alias("last")
    )
    return last.select("company", "last.*")


def read_kpis(
    spark: SparkSession, folder: str, projects: DataFrame, vehicles: DataFrame
) -> DataFrame:
    """One row like ``kpi_counts``: orders and companies as of the last finished batch."""
    now = _last_per_company(_read_log(spark, folder)).agg(
        F.count("company").alias("companies"),
        F.coalesce(F.sum("ready"), F.lit(0).cast("long")).alias("ready"),
    )
    return kpis_with(now, projects, vehicles)
