"""Counts for the dashboard, intake statistics and the company dimension."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave import fixed_values as fv
from loadweave import schemas
from loadweave.functions import names
from loadweave.functions.ordered import dense_ids, next_id
from loadweave.functions.times import stamp

KPI_NAMES = tuple(fv.KPI_FALLBACK)


def kpi_counts(
    projects: DataFrame,
    orders: DataFrame,
    vehicles: DataFrame,
    ready_status: str,
    company: str = "company",
    status: str = "status",
) -> DataFrame:
    """One row: projects, companies with an order, orders ready to allocate, vehicles.

    Orders are read once for both of their counts. The counts are stacked and
    folded, so nothing is joined.
    """
    of_orders = orders.agg(
        F.count_distinct(company).alias("companies"),
        F.count_if(F.col(status) == ready_status).alias("ready"),
    )
    return kpis_with(of_orders, projects, vehicles)


def kpis_with(of_orders: DataFrame, projects: DataFrame, vehicles: DataFrame) -> DataFrame:
    """The dashboard row from one row of ``companies`` and ``ready`` and two tables to count."""
    stacked = of_orders.select(
        F.inline(
            F.array(
                F.struct(F.lit("companies").alias("kpi"), F.col("companies").alias("n")),
                F.struct(F.lit("orders").alias("kpi"), F.col("ready").alias("n")),
            )
        )
    )
    return fold_kpis(
        stacked.unionByName(_count_as(projects, "projects")).unionByName(
            _count_as(vehicles, "vehicles")
        )
    )


def _count_as(df: DataFrame, kpi: str) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select(F.lit(kpi).alias("kpi"), "n")


def fold_kpis(stacked: DataFrame) -> DataFrame:
    """(kpi, n) rows to one row with a column per name; NULL where a name is absent."""
    return stacked.agg(*[F.max(F.when(F.col("kpi") == k, F.col("n"))).alias(k) for k in KPI_NAMES])


def kpi_fallback(live: DataFrame, defaults: Mapping[str, int] = fv.KPI_FALLBACK) -> DataFrame:
    """One row: the live value of each count, its default where that is missing.

    No live row at all gives all defaults, an absent column the default of it.
    """
    found = live.agg(
        F.count("*").alias("_rows"), *[F.max(k).alias(k) for k in defaults if k in live.columns]
    )
    return found.select(
        *[
            (F.coalesce(F.col(k), F.lit(v).cast("long")) if k in live.columns else F.lit(v).cast("long")).alias(k)
            for k, v in defaults.items()
        ]
    )


def intake_stats(files: DataFrame, types: Sequence[str] = fv.FILE_TYPES) -> DataFrame:
    """Files and bytes per request, a column pair per file type, 0 where there is none.

    Conditional aggregates over the known types: one shuffle, no pass to find them.
    """
    columns = [F.count("*").alias("files"), F.sum("file_size").alias("bytes")]
    for t in types:
        of_type = F.col("file_type") == t
        columns.append(F.count_if(of_type).alias(f"{t}_files"))
        columns.append(
            F.sum(F.when(of_type, F.col("file_size")).otherwise(F.lit(0).cast("long"))).alias(f"{t}_bytes")
        )
    return files.groupBy("request_id").agg(*columns)


def latest_status(feed: DataFrame) -> DataFrame:
    """id, status, css_class: the last status per id by (ts, event_id)."""
    last = feed.groupBy("id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    return last.withColumn("css_class", names.status_class("status"))


def company_dim(requests: DataFrame, existing: DataFrame | None, now: datetime) -> DataFrame:
    """The company table after the names in ``requests``: id, name, code and times.

    Companies already known stay as they are, whether a request names them or not; of
    several rows with one name the one with the smallest id stays. New names get the
    ids after the largest, in name order, no code, and ``now`` as both times. Names are
    trimmed and otherwise compared as they are.
    """
    named = (
        requests.select(F.trim("company_name").alias("name"))
        .filter(F.col("name") != "")
        .distinct()
    )
    columns = [F.col(f.name).cast(f.dataType) for f in schemas.COMPANIES.fields]
    if existing is None:
        known = named.sparkSession.createDataFrame([], schemas.COMPANIES)
    else:
        rest = F.struct("id", "code", "created_at", "updated_at")
        per_name = existing.groupBy(F.trim("name").alias("name")).agg(
            F.min_by(rest, "id").alias("row")
        )
        known = per_name.select("row.id", "name", "row.code", "row.created_at", "row.updated_at")
    new = named.join(known.select("name"), "name", "left_anti")
    # one number: the largest id, that of a dropped repeat included
    start = 1 if existing is None else next_id(existing)
    at = stamp(now)
    added = dense_ids(new, ["name"], "id", start).withColumns(
        {"code": F.lit(None).cast("string"), "created_at": at, "updated_at": at}
    )
    return known.select(*columns).unionByName(added.select(*columns))
