"""Declared constraints as checks.

Parquet tables keep none of the promises a database keeps, so each promise is a
query here. Rules come from the schema's column metadata.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave import schemas
from loadweave.functions import names
from loadweave.session import pin

REASONS = "reasons"


def is_missing(column: str) -> Column:
    """NULL or the empty string: forms deliver the latter for a field left out."""
    return F.col(column).isNull() | (F.col(column).cast("string") == "")


def fails_cast(column: str, data_type: str) -> Column:
    """Present, but not readable as ``data_type``."""
    return ~is_missing(column) & F.col(column).try_cast(data_type).isNull()


# ---- one row at a time: reasons ------------------------------------------------


def rule_reasons(
    schema: T.StructType, columns: Sequence[str] | None = None, casts: Mapping[str, str] | None = None
) -> Column:
    """Array of ``column:rule`` for the broken rules of a row, empty where all hold."""
    wanted = schema.names if columns is None else columns
    found = []

    def note(name, rule, broken):
        found.append(F.when(broken, F.lit(f"{name}:{rule}")))

    for name in wanted:
        meta = schema[name].metadata
        is_text = isinstance(schema[name].dataType, T.StringType)
        if meta.get("required"):
            note(name, "required", is_missing(name) if is_text else F.col(name).isNull())
        if "max_chars" in meta:
            note(name, "length", F.char_length(name) > meta["max_chars"])
        if "domain" in meta:
            note(name, "domain", ~is_missing(name) & ~F.col(name).isin(meta["domain"]))
    for name, data_type in (casts or {}).items():
        note(name, "type", fails_cast(name, data_type))
    return F.array_compact(F.array(*found))


def required_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with ``reasons``: the required columns that are missing."""
    missing = [F.when(is_missing(c), F.lit(f"{c}:required")) for c in columns]
    return df.withColumn(REASONS, F.array_compact(F.array(*missing)))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without reasons, rejected rows with reasons)."""
    ok = F.size(REASONS) == 0
    return checked.filter(ok).drop(REASONS), checked.filter(~ok)


def write_by_outcome(checked: DataFrame, path: str, reasons: Sequence[str] = ()) -> dict[str, int]:
    """Write checked rows in one pass, by outcome (``valid`` or ``rejected``); the counts of that pass.

    Counts: rows, rejected, and rows with each of ``reasons``. They are observed while the
    rows are written, so the input is read, and every check run, only once.
    """
    broken = F.size(REASONS) > 0
    counts = {"rows": F.count(F.lit(1)), "rejected": F.count_if(broken)}
    counts |= {r: F.count_if(F.array_contains(REASONS, r)) for r in reasons}
    seen = Observation("outcome")
    outcome = F.when(broken, "rejected").otherwise("valid")
    (
        checked.observe(seen, *[n.alias(name) for name, n in counts.items()])
        .withColumn("outcome", outcome)
        .write.partitionBy("outcome")
        .parquet(path)
    )
    return {name: int(n) for name, n in seen.get.items()}


# ---- whole columns --------------------------------------------------------------


def domain_check(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """value, rows: values outside the allowed set, with their counts."""
    outside = F.col(column).isNotNull() & ~F.col(column).isin(list(allowed))
    return df.filter(outside).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))


def unique_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with ``rows``; NULL keys are not compared."""
    present = df
    for key in keys:
        present = present.filter(F.col(key).isNotNull())
    return present.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def length_check(df: DataFrame, key: str, limits: Mapping[str, int]) -> DataFrame:
    """key, column, chars, max_chars: one row per value over its limit.

    Only the lengths of offending values leave the scan, never the values.
    """
    found = [
        F.when(
            F.char_length(column) > limit,
            F.struct(
                F.lit(column).alias("column"),
                F.char_length(column).alias("chars"),
                F.lit(limit).alias("max_chars"),
            ),
        )
        for column, limit in limits.items()
    ]
    return df.select(key, F.inline(F.array_compact(F.array(*found))))


def type_check(df: DataFrame, key: str, casts: Mapping[str, str]) -> DataFrame:
    """key, column, value, wanted: one row per value that cannot be read as its type."""
    found = [
        F.when(
            fails_cast(column, data_type),
            F.struct(
                F.lit(column).alias("column"),
                F.col(column).cast("string").alias("value"),
                F.lit(data_type).alias("wanted"),
            ),
        )
        for column, data_type in casts.items()
    ]
    return df.select(key, F.inline(F.array_compact(F.array(*found))))


def quality_profile(
    df: DataFrame,
    columns: Sequence[str],
    limits: Mapping[str, int] | None = None,
    unique: Sequence[str] = (),
) -> DataFrame:
    """One row per column: rows, nulls, empties, over_length, duplicates.

    All counts come from one pass; surplus rows of the columns in ``unique`` add
    one aggregate each. ``duplicates`` is 0 for the others, which promise nothing.
    Text without a declared limit is compared by its SHA-256, so that long values
    stay out of the shuffle.
    """
    limits = limits or {}
    zero = F.lit(0).cast("long")
    counts = [F.count("*").alias("_rows")]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    for c in columns:
        empty = F.col(c) == "" if c in texts else F.lit(False)
        counts.append(F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"))
        counts.append(F.count_if(empty).alias(f"{c}_empties"))
        over = F.char_length(c) > limits[c] if c in limits else F.lit(False)
        counts.append(F.count_if(over).alias(f"{c}_over"))
    lines = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("_rows").alias("rows"),
            F.col(f"{c}_nulls").alias("nulls"),
            F.col(f"{c}_empties").alias("empties"),
            F.col(f"{c}_over").alias("over_length"),
            zero.alias("duplicates"),
        )
        for c in columns
    ]
    profile = df.agg(*counts).select(F.inline(F.array(*lines)))
    for c in unique:
        value = F.sha2(c, 256) if c in texts and c not in limits else F.col(c)
        surplus = unique_check(df.select(value.alias(c)), [c]).agg(
            F.sum(F.col("rows") - 1).alias("n")
        )
        line = surplus.select(
            F.lit(c).alias("column"),
            *[zero.alias(n) for n in ("rows", "nulls", "empties", "over_length")],
            F.coalesce("n", zero).alias("duplicates"),
        )
        profile = profile.unionByName(line)
    if not unique:
        return profile
    return profile.groupBy("column").agg(
        *[F.sum(n).alias(n) for n in ("rows", "nulls", "empties", "over_length", "duplicates")]
    )


def profile_by_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``quality_profile`` with limits and unique columns as the schema declares them."""
    present = [n for n in schema.names if n in df.columns]
    limits = {k: v for k, v in schemas.fields_with(schema, "max_chars").items() if k in present}
    unique = [k for k in schemas.fields_with(schema, "unique") if k in present]
    return quality_profile(df, present, limits, unique)


# ---- catalogue against disk -----------------------------------------------------


def storage_reconcile(landed: DataFrame, files: DataFrame) -> DataFrame:
    """path, class, disk_bytes, row_bytes, rows for every path on disk or in the catalogue.

    ``landed`` has path and size, ``files`` the file rows. Rows that share a path
    are reduced to the last writer first, so both sides have one row per path and
    no path can be hot in the join. A path outside the upload folder's scheme stays
    whole and has a class of its own.
    """
    disk, rows = _on_disk(landed), _catalogued(files)
    return disk.join(rows, "path", "full_outer").select(*_reconciled())


def _on_disk(landed: DataFrame) -> DataFrame:
    return landed.select(names.relative_path("path").alias("path"), F.col("size").alias("disk_bytes"))


def _catalogued(files: DataFrame) -> DataFrame:
    return files.groupBy(names.relative_path("file_path").alias("path")).agg(
        F.max_by("file_size", "id").alias("row_bytes"), F.count("*").alias("rows")
    )


def _reconciled() -> list[Column]:
    kind = (
        F.when(~names.is_landing_path("path"), "unrecognised_path")
        .when(F.col("rows").isNull(), "bytes_without_row")
        .when(F.col("disk_bytes").isNull(), "row_without_bytes")
        .when(F.col("disk_bytes") == F.col("row_bytes"), "ok")
        .otherwise("size_mismatch")
    )
    none = F.lit(0).cast("long")
    return [F.col("path"), kind.alias("class"), *map(F.col, ("disk_bytes", "row_bytes")), F.coalesce("rows", none).alias("rows")]


BUCKETS = 4096


def unequal_buckets(disk: DataFrame, rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The buckets of paths, of ``_bucket``, whose paths and sizes differ between the sides.

    Each side sums up a hash of every path and size, and counts them: neither order nor place matters,
    and one row per bucket is all that is shuffled.
    """

    def digest(df, size, name):
        line = F.xxhash64("path", size, F.col(size).isNull()).cast("decimal(38,0)")
        return df.groupBy("_bucket").agg(F.struct(F.count("*"), F.sum(line)).alias(name))

    both = digest(disk, "disk_bytes", "a").join(digest(rows, "row_bytes", "b"), "_bucket", "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("_bucket")


def reconcile_by_digest(landed: DataFrame, files: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``storage_reconcile`` for sides that agree on most paths.

    Paths are dealt into buckets by hash. Only rows of buckets whose digests differ (``unequal_buckets``) are
    shuffled and joined; those of equal buckets come out as they are. Two different buckets would pass as equal
    if the sums of their 64-bit hashes were the same.
    """

    def bucketed(df):
        # a NULL path equals none, so its rows always go to the join
        place = F.when(F.col("path").isNotNull(), F.pmod(F.xxhash64("path"), F.lit(buckets)))
        return df.withColumn("_bucket", place)

    disk, rows = bucketed(_on_disk(landed)), pin(bucketed(_catalogued(files)))
    keyed = F.col("_bucket").isNotNull()
    differ = pin(unequal_buckets(disk.filter(keyed), rows.filter(keyed), buckets))

    def of(df, how):
        return df.filter(keyed).join(differ, "_bucket", how)

    met = [of(df, "left_semi").unionByName(df.filter(~keyed)).drop("_bucket") for df in (disk, rows)]
    joined = met[0].join(met[1], "path", "full_outer").select(*_reconciled())
    same = of(rows, "left_anti").withColumn("disk_bytes", F.col("row_bytes")).select(*_reconciled())
    return joined.unionByName(same)


def reconcile_summary(reconciled: DataFrame) -> DataFrame:
    """Paths and bytes per class."""
    return reconciled.groupBy("class").agg(
        F.count("*").alias("paths"),
        F.coalesce(F.sum("disk_bytes"), F.lit(0).cast("long")).alias("disk_bytes"),
        F.coalesce(F.sum("row_bytes"), F.lit(0).cast("long")).alias("row_bytes"),
    )
