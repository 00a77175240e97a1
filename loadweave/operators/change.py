"""Updates with audit times, and schema changes up and down."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave import schemas
from loadweave.functions.times import stamp, utc_instant, utc_naive
from loadweave.operators.quality import REASONS, split_valid


def latest_changes(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change per key, combined before the shuffle."""
    values = [c for c in changes.columns if c not in (key, order)]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_last"))
    return last.select(key, "_last.*")


def audit_upsert(
    snapshot: DataFrame, changes: DataFrame, now: datetime, key: str = "id", order: str | None = None
) -> DataFrame:
    """Snapshot after the changes.

    ``created_at`` is set once; ``updated_at`` becomes ``now`` only on rows where a
    value differs. Of several changes to a key the last by ``order`` counts, or, without
    an order, the one with the largest values. Keys of the snapshot are unique, so both
    sides meet in one full outer join, each read and shuffled once.
    """
    values = [c for c in changes.columns if c not in (key, order)]
    new = F.struct(*values)
    last = F.max_by(new, order) if order else F.max(new)
    incoming = changes.groupBy(F.col(key).alias("_key")).agg(last.alias("_new"))
    old = snapshot.select(F.col(key).alias("_old_key"), F.struct("*").alias("_old"))
    met = old.join(incoming, F.col("_old_key") == F.col("_key"), "full_outer")
    added, changed = F.col("_old").isNull(), F.col("_new").isNotNull()
    differs = F.lit(False)
    for c in values:
        differs = differs | ~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))

    def after(c):
        before = F.col(f"_old.{c}")
        at = stamp(now, snapshot.schema[c].dataType) if c in ("created_at", "updated_at") else None
        if c == key:
            return F.coalesce("_old_key", "_key")
        if c == "created_at":
            return F.when(added, at).otherwise(before)
        if c == "updated_at":
            return F.when(added | (changed & differs), at).otherwise(before)
        return F.when(changed, F.col(f"_new.{c}")).otherwise(before) if c in values else before

    return met.select(*[after(c).alias(c) for c in snapshot.columns])


def evolve_up(requests: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(requests in the later schema, rows that break it).

    Adds ``updated_at``, turns the naive ``created_at`` into an instant, and asks
    for status and created_at to be present.
    """
    # present is all the later schema asks for: an empty status is a value
    missing = [F.when(F.col(c).isNull(), F.lit(f"{c}:required")) for c in ("status", "created_at")]
    checked = requests.withColumn(REASONS, F.array_compact(F.array(*missing)))
    valid, rejected = split_valid(checked)
    evolved = valid.withColumns({"created_at": utc_instant("created_at"), "updated_at": stamp(now)})
    return evolved, rejected


def evolve_down(requests: DataFrame) -> DataFrame:
    """Requests in the earlier schema: no ``updated_at``, naive ``created_at``."""
    return requests.drop("updated_at").withColumn("created_at", utc_naive("created_at"))


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def create_table(spark: SparkSession, table: str, schema: T.StructType, path: str) -> None:
    """A declared table in the catalogue, without rows, as a schema change creates it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE {_quoted(table)} ({columns}) USING parquet LOCATION '{path}'")


def add_column(spark: SparkSession, table: str, column: str, kind: str, default: str) -> None:
    """A later column of a catalogue table. No file is written: rows from before show the default.

    ``default`` is a SQL literal. Rows that are inserted without the column get it as well.
    """
    spark.sql(f"ALTER TABLE {_quoted(table)} ADD COLUMNS (`{column}` {kind} DEFAULT {default})")


def evolve_table_up(spark: SparkSession, requests: str, files: str, files_path: str, now: datetime) -> None:
    """The later schema in the catalogue: requests get ``updated_at``, and their files a table."""
    at = now.astimezone(UTC) if now.tzinfo else now
    add_column(spark, requests, "updated_at", "timestamp", f"TIMESTAMP '{at:%Y-%m-%d %H:%M:%S.%f}Z'")
    create_table(spark, files, schemas.REQUEST_FILES, files_path)


def empty_table(spark: SparkSession, schema=schemas.REQUEST_FILES) -> DataFrame:
    """A declared table without rows, as a schema change creates it."""
    return spark.createDataFrame([], schema)

