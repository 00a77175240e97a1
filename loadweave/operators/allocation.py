"""Orders to vehicles, zone by zone, within capacity.

Within a zone the orders queue by (order_ts, order_id), and the running load
gives each order the interval [lo, hi). The vehicles line up by vehicle_id, and
the running capacity gives each the interval [vlo, vhi). An order goes to the
vehicle whose interval holds its own. This is first fit by position: capacity
is never exceeded, but the outcome is not an optimum.

Inputs
    orders  zone, order_id, order_ts, load (whole number, 0 or more)
    fleet   zone, vehicle_id, capacity (whole number, above 0)

(zone, order_id) and (zone, vehicle_id) are unique. Loads and capacities are
whole numbers so that running totals do not depend on the order of addition.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave import fixed_values as fv
from loadweave.functions.ordered import (
    carry_forward,
    range_offsets,
    running_total,
    split_ranges,
    total_in_ranges,
)
from loadweave.functions.times import stamp
from loadweave.operators.relations import join_aggregated

RUN_FAILED = "failed"
RUN_EMPTY = "empty"
ZERO_LOAD = "zero_load"
NO_FLEET = "no_fleet"
FLEET_FULL = "fleet_full"
STRADDLES = "straddles_vehicles"


def vehicle_spans(fleet: DataFrame, ranges: int | None = None) -> DataFrame:
    """zone, vehicle: each vehicle with its capacity interval [vlo, vhi)."""
    usable = fleet.filter(F.col("zone").isNotNull() & (F.col("capacity") > 0)).select(
        "zone", "vehicle_id", F.col("capacity").cast("long").alias("capacity")
    )
    summed = running_total(usable, ["zone"], ["vehicle_id"], "capacity", "vhi", ranges)
    return summed.select(
        "zone",
        F.struct(
            (F.col("vhi") - F.col("capacity")).alias("vlo"), "vhi", "vehicle_id"
        ).alias("vehicle"),
    )


def marks_by_place(orders: DataFrame, fleet: DataFrame, ranges: int | None = None) -> DataFrame:
    """zone, at, kind, order columns and ``open``: where orders and vehicles start.

    Vehicles that start behind all of their zone's orders can take none and are left
    out; of the others each is one row, so orders plus vehicles bounds the outcome.
    """
    load = F.greatest(F.coalesce("load", F.lit(0)), F.lit(0)).cast("long")
    by = ["zone", "order_ts", "order_id"]
    queue = split_ranges(orders.select(*by, load.alias("load")), by, ranges)
    offsets = range_offsets(queue, ["zone"], "load")
    placed = total_in_ranges(queue, offsets, ["zone"], ["order_ts", "order_id"], "load", "hi")
    # one row per zone
    totals = queue.groupBy("zone").agg(F.sum("load").alias("total"))
    reached = join_aggregated(vehicle_spans(fleet, ranges), totals, "zone").filter(
        F.col("vehicle.vlo") < F.col("total")
    )
    return placed.select(
        "zone",
        (F.col("hi") - F.col("load")).alias("at"),
        F.lit(1).alias("kind"),
        "order_ts",
        "order_id",
        "load",
    ).unionByName(
        reached.select(
            "zone",
            F.col("vehicle.vlo").alias("at"),
            F.lit(0).alias("kind"),
            F.col("vehicle").alias("open"),
        ),
        allowMissingColumns=True,
    )


def allocate_orders(orders: DataFrame, fleet: DataFrame, ranges: int | None = None) -> DataFrame:
    """order_id, zone, order_ts, load, vehicle_id, reason: one row per order.

    ``vehicle_id`` is NULL where no vehicle was found and ``reason`` then says
    why. A missing or negative load counts as 0. One plan for all sizes: orders and
    vehicles each get their place by a running total over ranges, then both are split
    by place together, and each order finds the vehicle last opened before it. So
    neither a zone nor a place crowded with orders or vehicles has to fit into one task.
    """
    order = ["at", "kind", "order_ts", "order_id"]
    marks = marks_by_place(orders, fleet, ranges)
    matched = carry_forward(marks, ["zone"], order, ["open"], ranges).filter("kind = 1")
    reason = (
        F.when(F.col("load") == 0, ZERO_LOAD)
        .when(F.col("open").isNull(), NO_FLEET)
        .when(F.col("at") >= F.col("open.vhi"), FLEET_FULL)
        .when(F.col("at") + F.col("load") > F.col("open.vhi"), STRADDLES)
    )
    return matched.withColumn("reason", reason).select(
        "order_id",
        "zone",
        "order_ts",
        "load",
        F.when(F.col("reason").isNull(), F.col("open.vehicle_id")).alias("vehicle_id"),
        "reason",
    )


def manual_review(allocation: DataFrame) -> DataFrame:
    """Orders that no vehicle took, with the reason."""
    return allocation.filter(F.col("reason").isNotNull()).select(
        "order_id", "zone", "load", "reason"
    )


def unassigned(orders: DataFrame, assignments: DataFrame) -> DataFrame:
    """Orders that have no recorded assignment.

    An order may have very many assignments; they are reduced before the shuffle.
    """
    return orders.join(assignments.select("order_id").distinct(), "order_id", "left_anti")


def load_by_vehicle(allocation: DataFrame, fleet: DataFrame) -> DataFrame:
    """zone, vehicle_id, capacity, orders, load; vehicle_id NULL counts what is left over.

    Fleet rows enter as rows without orders, so unused vehicles appear and the
    allocation is aggregated once, before any shuffle.
    """
    taken = allocation.select(
        "zone",
        "vehicle_id",
        F.lit(None).cast("long").alias("capacity"),
        F.lit(1).cast("long").alias("orders"),
        "load",
    )
    vehicles = fleet.select(
        "zone",
        "vehicle_id",
        F.col("capacity").cast("long").alias("capacity"),
        F.lit(0).cast("long").alias("orders"),
        F.lit(0).cast("long").alias("load"),
    )
    return (
        taken.unionByName(vehicles)
        .groupBy("zone", "vehicle_id")
        .agg(
            F.max("capacity").alias("capacity"),
            F.sum("orders").alias("orders"),
            F.sum("load").alias("load"),
        )
    )


def vehicle_load(allocation: DataFrame, fleet: DataFrame) -> DataFrame:
    """Orders, load, capacity and fill in basis points per vehicle, unused ones included."""
    return (
        load_by_vehicle(allocation, fleet)
        .filter(F.col("vehicle_id").isNotNull())
        .withColumn("fill_bp", fill_bp())
    )


def fill_bp():
    """Load over capacity in whole basis points, rounded down."""
    return F.expr("load * 10000L div nullif(capacity, 0L)")


def _outcome():
    used = F.col("vehicle_id").isNotNull() & (F.col("orders") > 0)
    left = F.col("vehicle_id").isNull()
    used_count = F.count_if(used)
    fill_sum = F.sum(F.when(used, fill_bp()))
    return [
        F.coalesce(F.sum(F.when(~left, F.col("orders"))), F.lit(0).cast("long")).alias("allocated"),
        F.coalesce(F.sum(F.when(left, F.col("orders"))), F.lit(0).cast("long")).alias("remaining"),
        used_count.alias("vehicles_used"),
        F.count_if(~left).alias("vehicles_total"),
        F.coalesce(
            F.floor(F.try_divide(fill_sum.cast("decimal(20,0)"), used_count)).cast("long"),
            F.lit(0).cast("long"),
        ).alias("efficiency_bp"),
    ]


def run_summary(allocation: DataFrame, fleet: DataFrame) -> DataFrame:
    """One row: allocated, remaining, vehicles used and in all, mean fill of used vehicles."""
    return load_by_vehicle(allocation, fleet).agg(*_outcome())


def run_summary_by_zone(allocation: DataFrame, fleet: DataFrame) -> DataFrame:
    """The same per zone, with a total row where ``is_total`` is 1."""
    return (
        load_by_vehicle(allocation, fleet)
        .rollup("zone")
        .agg(F.grouping("zone").cast("int").alias("is_total"), *_outcome())
    )


def input_digest(orders: DataFrame, fleet: DataFrame) -> DataFrame:
    """One row with numbers that depend on the input rows as given, not on their order.

    NULL, negative and zero loads are different inputs. Each row adds the first 60 bits of a
    SHA-256 over its values; sums are decimals and cannot overflow.
    """

    def part(kind, df, *columns):
        values = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
        digest = F.sha2(F.concat(F.lit(f"{kind}|"), F.array_join(values, "|")), 256)
        return df.select(F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)").alias("h"))

    order_ts = F.date_format("order_ts", "yyyy-MM-dd HH:mm:ss")
    rows = part(
        "order", orders.withColumn("order_ts", order_ts), "zone", "order_id", "order_ts", "load"
    ).unionByName(part("vehicle", fleet, "zone", "vehicle_id", "capacity"))
    return rows.agg(
        F.coalesce(F.sum("h"), F.lit(0)).cast("decimal(38,0)").alias("digest"),
        F.count("*").alias("input_rows"),
    )


def run_log(
    summary: DataFrame, digest: DataFrame, params: str = "", now: datetime | None = None
) -> DataFrame:
    """One log row per run: run_id, status, message, params, the counts and run_at.

    A run that allocated something is a success, one without any order is empty, and
    one that had orders and placed none has failed.

    Equal inputs and parameters give the same run_id, so a repeated run can be
    recognised. Both inputs have one row; they are stacked and folded into one.
    """
    stacked = summary.unionByName(digest, allowMissingColumns=True)
    both = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    seed = F.concat_ws("|", F.lit(params), F.col("digest").cast("string"), "input_rows")
    status = (
        F.when(F.col("allocated") > 0, fv.RUN_SUCCESS)
        .when(F.col("remaining") > 0, RUN_FAILED)
        .otherwise(RUN_EMPTY)
    )
    message = F.format_string(
        "%d orders allocated, %d left for review, %d of %d vehicles used",
        "allocated",
        "remaining",
        "vehicles_used",
        "vehicles_total",
    )
    return both.select(
        F.concat(F.lit("run-"), F.substring(F.sha2(seed, 256), 1, 16)).alias("run_id"),
        status.alias("status"),
        message.alias("message"),
        F.lit(params).alias("params"),
        "allocated",
        "remaining",
        "vehicles_used",
        "vehicles_total",
        "efficiency_bp",
        stamp(now or datetime.now(UTC)).alias("run_at"),
    )
