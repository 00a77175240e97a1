import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tests.helpers import plan, rows, settings

from loadweave.functions.ordered import split_ranges
from loadweave.operators import allocation as al
from loadweave.sources.tables import append_run

DAY = datetime(2024, 1, 1)
ORDERS = "zone int, order_id long, order_ts timestamp_ntz, load long"
FLEET = "zone int, vehicle_id long, capacity long"


def brute_force(orders, fleet):
    spans, totals = defaultdict(list), defaultdict(int)
    for zone, vehicle, capacity in sorted(fleet):
        spans[zone].append((totals[zone], totals[zone] + capacity, vehicle))
        totals[zone] += capacity
    at, found = defaultdict(int), {}
    for zone, order, _, load in sorted(orders, key=lambda o: (o[0], o[2], o[1])):
        lo, hi = at[zone], at[zone] + load
        at[zone] = hi
        vehicle, reason = None, None
        if load == 0:
            reason = al.ZERO_LOAD
        elif not spans[zone]:
            reason = al.NO_FLEET
        elif lo >= totals[zone]:
            reason = al.FLEET_FULL
        else:
            vehicle = next((v for a, b, v in spans[zone] if a <= lo and hi <= b), None)
            reason = None if vehicle is not None else al.STRADDLES
        found[order] = (vehicle, reason)
    return sorted(((o, *v) for o, v in found.items()), key=repr)


def made_up(seed, n=700, vehicles=60, top_load=30):
    rng = random.Random(seed)

    def zone():
        return 1 if rng.random() < 0.6 else rng.randint(2, 6)

    orders = [
        (zone(), i, DAY + timedelta(days=rng.randint(0, 3)), rng.choice([0, rng.randint(1, top_load)]))
        for i in range(n)
    ]
    # zone 6 has no vehicle, zone 9 has no order
    fleet = [(min(zone(), 5) if v else 9, v, rng.randint(1, 200)) for v in range(vehicles)]
    return orders, fleet


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("ranges", [None, 1, 11])
@pytest.mark.parametrize("vehicles", [60, 1000])
def test_matches_brute_force(spark, seed, ranges, vehicles):
    # 1000 vehicles: a surplus that starts behind the last order of a zone
    orders, fleet = made_up(seed, vehicles=vehicles)
    got = al.allocate_orders(
        spark.createDataFrame(orders, ORDERS), spark.createDataFrame(fleet, FLEET), ranges
    )
    assert rows(got, "order_id", "vehicle_id", "reason") == brute_force(orders, fleet)


@pytest.mark.parametrize(
    "orders, fleet",
    [
        ([], [(1, 1, 5)]),
        ([(1, 1, DAY, 5)], []),
        # one vehicle over all ranges, one order over all vehicles
        ([(1, i, DAY, 1) for i in range(50)], [(1, 1, 10_000)]),
        ([(1, 1, DAY, 10_000), (1, 2, DAY, 1)], [(1, v, 7) for v in range(50)]),
        # only orders without load, then one with
        ([(1, i, DAY, 0) for i in range(30)] + [(1, 99, DAY, 5)], [(1, 1, 5)]),
        # same instant everywhere, intervals that meet exactly
        ([(1, i, DAY, 5) for i in range(40)], [(1, v, 5) for v in range(39)]),
    ],
)
def test_edges_match_brute_force(spark, orders, fleet):
    got = al.allocate_orders(
        spark.createDataFrame(orders, ORDERS), spark.createDataFrame(fleet, FLEET), 5
    )
    assert rows(got, "order_id", "vehicle_id", "reason") == brute_force(orders, fleet)


def test_orders_without_zone_or_load_are_left_for_review(spark):
    orders = spark.createDataFrame(
        [(None, 1, DAY, 5), (1, 2, DAY, None), (1, 3, DAY, -7)], ORDERS
    )
    fleet = spark.createDataFrame([(None, 1, 50), (1, 2, 50)], FLEET)
    got = rows(al.manual_review(al.allocate_orders(orders, fleet)), "order_id", "reason")
    assert got == [(1, al.NO_FLEET), (2, al.ZERO_LOAD), (3, al.ZERO_LOAD)]


def test_keys_may_be_text(spark):
    orders, fleet = made_up(7, 200, 20)

    def text(zone, key):
        return f"z{zone}", f"{key:05d}"

    orders = [(*text(z, i), t, load) for z, i, t, load in orders]
    fleet = [(*text(z, v), c) for z, v, c in fleet]
    o = spark.createDataFrame(orders, "zone string, order_id string, order_ts timestamp_ntz, load int")
    f = spark.createDataFrame(fleet, "zone string, vehicle_id string, capacity int")
    got = al.allocate_orders(o, f, 4)
    assert rows(got, "order_id", "vehicle_id", "reason") == brute_force(orders, fleet)


def test_no_range_gets_more_than_its_share(spark):
    # one zone, more vehicles than orders, most of them behind the last order
    orders = [(1, i, DAY, 10) for i in range(1000)]
    fleet = [(1, v, 3 if v < 3000 else 100) for v in range(5000)]
    marks = al.marks_by_place(spark.createDataFrame(orders, ORDERS), spark.createDataFrame(fleet, FLEET), 8)
    assert marks.filter("kind = 0").count() == 3010  # the rest starts behind the last order
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        split = split_ranges(marks, ["zone", "at", "kind", "order_ts", "order_id"], 8)
    sizes = [r["count"] for r in split.groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.5 * sum(sizes) / 8


def test_summary_invariants(spark):
    orders, fleet = made_up(5)
    o, f = spark.createDataFrame(orders, ORDERS), spark.createDataFrame(fleet, FLEET)
    a = al.allocate_orders(o, f)
    s = al.run_summary(a, f).first()
    assert s["allocated"] + s["remaining"] == len(orders)
    assert s["vehicles_used"] <= s["vehicles_total"] == len(fleet)
    assert 0 <= s["efficiency_bp"] <= 10_000
    loads = al.vehicle_load(a, f)
    assert loads.count() == len(fleet)
    assert loads.filter(F.col("load") > F.col("capacity")).isEmpty()
    zones = al.run_summary_by_zone(a, f)
    total = zones.filter("is_total = 1").drop("zone", "is_total").first()
    assert total == s
    assert zones.filter("is_total = 0").agg(F.sum("allocated")).first()[0] == s["allocated"]


def test_empty_run_has_a_summary(spark):
    o, f = spark.createDataFrame([], ORDERS), spark.createDataFrame([], FLEET)
    assert tuple(al.run_summary(al.allocate_orders(o, f), f).first()) == (0, 0, 0, 0, 0)


def test_run_id_depends_on_the_rows_not_on_their_order(spark, tmp_path):
    orders, fleet = made_up(4, 60, 10)

    def run_id(order_rows, params="", status="success"):
        o, f = spark.createDataFrame(order_rows, ORDERS), spark.createDataFrame(fleet, FLEET)
        summary = al.run_summary(al.allocate_orders(o, f), f)
        log = al.run_log(summary, al.input_digest(o, f), params, DAY)
        append_run(log, str(tmp_path))
        row = log.first()
        assert row["status"] == status
        return row["run_id"]

    same = run_id(orders)
    assert same == run_id(list(reversed(orders)))
    ids = {same, run_id(orders[1:]), run_id(orders, "other"), run_id([], status="empty")}
    # loads that count alike are different inputs
    one = [run_id([(1, 1, DAY, load)], status="failed") for load in (0, None, -5)]
    assert len(ids | set(one)) == 7
    # the repeated run has one entry
    assert spark.read.parquet(str(tmp_path)).count() == 7


def test_unassigned(spark):
    orders = spark.createDataFrame([(1,), (2,), (3,)], "order_id long")
    assert rows(al.unassigned(orders, orders.filter("order_id = 2"))) == [(1,), (3,)]


def test_plan_has_no_pair_join(spark):
    orders, fleet = made_up(1)
    text = plan(al.allocate_orders(spark.createDataFrame(orders, ORDERS), spark.createDataFrame(fleet, FLEET)))
    assert "Cartesian" not in text and "NestedLoop" not in text and "Join" not in text
