"""What the plans read, shuffle and avoid."""

import re

import pytest
from tests.helpers import plan

from loadweave.operators import quality, reports
from loadweave.plans import registry, standins

SF = "/root/testdata/sf0.001"

# queries whose result is plain DataFrame code, so the plan shows all of it
LAZY = [
    q
    for q in registry.all_queries()
    if not q.endswith("_stream") and q not in ("layout", "request_file_append", "disk_manifest")
]


@pytest.mark.parametrize("name", LAZY)
def test_no_pair_joins_and_no_python(spark, name):
    text = plan(registry.all_queries()[name](spark, SF))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "MapInArrow"):
        assert node not in text


def scanned(df, table):
    """Columns read of one table, over all its scans."""
    found = set()
    for scan in re.findall(r"FileScan parquet.*", plan(df)):
        if f"/{table}.parquet" in scan:
            found |= set(re.findall(r"(\w+):\w+", scan.split("ReadSchema: struct<")[1]))
    return found


def test_only_needed_columns_are_read(spark):
    orders = standins.delivery_orders(spark, SF)
    assert scanned(orders, "lineitem") == {"l_orderkey", "l_quantity"}
    assert scanned(orders, "orders") == {"o_orderkey", "o_custkey", "o_orderdate"}
    kpis = registry.kpi_counts(spark, SF)
    assert scanned(kpis, "orders") == {"o_custkey", "o_orderstatus"}
    assert scanned(registry.size_bytes(spark, SF), "documents") == {"doc_id", "text", "n_chars"}


def test_filters_reach_the_scan(spark):
    assert "EqualTo(o_orderkey,7)" in plan(registry.request_lookup(spark, SF))
    assert "LessThan(o_orderkey,1200)" in plan(registry.request_page(spark, SF))
    assert "Not(In(event_type" in plan(registry.domain_check(spark, SF))


def test_aggregates_combine_before_the_shuffle(spark):
    files = standins.request_files(spark, SF)
    for df in (
        reports.intake_stats(files, standins.EVENT_TYPES),
        quality.unique_check(files, ["stored_name"]),
        quality.domain_check(files, "file_type", ["click"]),
    ):
        text = plan(df)
        assert "partial_" in text.split("Exchange", 1)[1]
        assert text.count("Exchange") == 1


def test_slots_are_expanded_without_a_shuffle(spark):
    for name in ("slot_unpivot", "slot_filter", "length_check", "type_check", "file_manifest"):
        assert "Exchange hash" not in plan(registry.all_queries()[name](spark, SF))
