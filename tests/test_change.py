import os
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tests.helpers import plan, rows, settings

from loadweave import schemas
from loadweave.operators import change

T0, T1, T2 = datetime(2024, 1, 1), datetime(2025, 1, 1), datetime(2026, 1, 1)
SNAP = "id long, a string, b string, created_at timestamp_ntz, updated_at timestamp_ntz"


def snapshot(spark):
    return spark.createDataFrame(
        [(1, "x", "y", T0, T0), (2, "x", None, T0, T1), (3, "k", "k", T0, T0)], SNAP
    )


def test_upsert_sets_times_only_where_values_differ(spark):
    changes = spark.createDataFrame([(1, "x", "y"), (2, "x", "new"), (4, "n", None)], "id long, a string, b string")
    after = change.audit_upsert(snapshot(spark), changes, T2)
    assert rows(after) == [
        (1, "x", "y", T0, T0),
        (2, "x", "new", T0, T2),
        (3, "k", "k", T0, T0),
        (4, "n", None, T2, T2),
    ]
    again = change.audit_upsert(after, changes, datetime(2030, 1, 1))
    assert rows(again) == rows(after)


def test_upsert_can_set_null_and_leave_columns_out(spark):
    changes = spark.createDataFrame([(1, None)], "id long, b string")
    after = change.audit_upsert(snapshot(spark), changes, T2)
    assert rows(after.filter("id = 1")) == [(1, "x", None, T0, T2)]


def test_each_side_is_read_and_joined_once(spark, tmp_path):
    wide = spark.range(1000).select(
        "id", F.lit("v").alias("a"), F.lit(T0).cast("timestamp_ntz").alias("created_at"),
        F.lit(T0).cast("timestamp_ntz").alias("updated_at"),
    )
    wide.write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([(1, "w")], "id long, a string").write.parquet(str(tmp_path / "c"))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        after = change.audit_upsert(
            spark.read.parquet(str(tmp_path / "s")), spark.read.parquet(str(tmp_path / "c")), T2
        )
        text = plan(after)
    assert text.count("FileScan") == 2 and text.count("SortMergeJoin") == 1


def test_several_changes_to_a_key_give_one_row(spark):
    changes = spark.createDataFrame(
        [(1, "b", "y", 2), (1, "c", "y", 1), (4, "n", None, 5), (4, "m", None, 4)],
        "id long, a string, b string, turn int",
    )
    after = change.audit_upsert(snapshot(spark), changes, T2, order="turn")
    assert rows(after.filter("id in (1, 4)"), "id", "a") == [(1, "b"), (4, "n")]
    unordered = change.audit_upsert(snapshot(spark), changes.drop("turn"), T2)
    assert rows(unordered.filter("id in (1, 4)"), "id", "a") == [(1, "c"), (4, "n")]


def test_times_do_not_follow_the_zone_of_the_machine():
    code = """
from datetime import datetime
from loadweave.session import build_session
from loadweave.operators import change
from loadweave.functions.times import stamp
spark = build_session("zone", "local[1]", **{"spark.ui.enabled": "false"})
old = spark.createDataFrame([(1, "")], "id long, status string").selectExpr("*", "timestamp_ntz'2026-01-01 00:00:00' created_at")
up, _ = change.evolve_up(old, datetime(2026, 1, 1))
print("FOUND", up.selectExpr("unix_micros(created_at) c", "unix_micros(updated_at) u").first())
"""
    root = str(Path(__file__).resolve().parents[1])
    out = subprocess.run(
        [sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120,
        env=os.environ | {"TZ": "Asia/Tehran", "PYTHONPATH": root},
    ).stdout
    assert "FOUND Row(c=1767225600000000, u=1767225600000000)" in out


def test_latest_change_wins(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2)], "id long, a string, seq int")
    assert rows(change.latest_changes(df, "id", "seq")) == [(1, "b")]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_up_and_down_is_the_identity(spark, zone):
    with settings(spark, spark__sql__session__timeZone=zone):
        up_and_down(spark)


def up_and_down(spark):
    old = spark.createDataFrame(
        [(1, "S", datetime(2024, 3, 31, 2, 30, 0, 123456)), (2, "S", datetime(1969, 12, 31, 23, 59, 59))],
        "id long, status string, created_at timestamp_ntz",
    )
    up, bad = change.evolve_up(old, T2)
    assert bad.count() == 0
    assert dict(up.dtypes)["created_at"] == dict(up.dtypes)["updated_at"] == "timestamp"
    down = change.evolve_down(up)
    assert down.schema == old.schema
    assert rows(down) == rows(old)


def test_up_holds_back_rows_that_break_the_schema(spark):
    old = spark.createDataFrame([(1, None, T0), (2, "S", None), (3, "S", T0), (4, "", T0)], "id long, status string, created_at timestamp_ntz")
    up, bad = change.evolve_up(old, T2)
    assert rows(up, "id") == [(3,), (4,)] and rows(bad, "id") == [(1,), (2,)]


def test_new_table_is_empty(spark):
    assert change.empty_table(spark).columns == schemas.REQUEST_FILES.names
