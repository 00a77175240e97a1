from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F
from tests.helpers import rows

from loadweave import fixed_values as fv
from loadweave.functions import names

HEX = "0123456789abcdef" * 2
EDGE_NAMES = [
    "a.csv",
    "a.tar.gz",
    ".bashrc",
    ".bashrc.txt",
    "noext",
    "trailing.",
    "a..b",
    "..",
    "سفارش ها.xlsx",
    "with space.csv",
    "100%.csv",
    "UPPER.CSV",
    "a.b c",
]


def test_suffix_is_what_pathlib_gives(spark):
    df = spark.createDataFrame([(n,) for n in EDGE_NAMES], "name string")
    got = dict(df.select("name", names.file_suffix("name")).collect())
    # a trailing dot is not a suffix here, whatever this Python's pathlib says
    expected = {n: PurePosixPath(n).suffix for n in EDGE_NAMES if not n.endswith(".")}
    assert {n: s for n, s in got.items() if n in expected} == expected
    assert got["trailing."] == "" and got[".."] == ""


@pytest.mark.parametrize("name", ["x.csv", "other_y.csv", "سفارش ۱.xlsx", "50% off.csv", "a\nb.csv"])
@pytest.mark.parametrize("kind", fv.FILE_TYPES)
def test_form_path_round_trip(spark, name, kind):
    df = spark.createDataFrame([(42, kind, name)], "id long, t string, n string")
    path = F.concat(F.lit("file:/mnt/"), names.landing_path_form("id", "t", "n"))
    p = df.select(names.parsed_path(path).alias("p")).first()["p"]
    assert tuple(p) == (42, "form", kind, name)


@pytest.mark.parametrize(
    "path, expected",
    [
        (f"uploads/7/{HEX}.csv", (7, "upload", None, None)),
        (f"s3a://b/uploads/7/{HEX}", (7, "upload", None, None)),
        ("uploads/7/8_orders_x.csv", (7, "unknown", None, None)),
        ("uploads/7/7_maps_x.csv", (7, "unknown", None, None)),
        ("elsewhere/7/7_orders_x.csv", (None, "unknown", None, None)),
        ("uploads/99999999999999999999/x", (None, "unknown", None, None)),
    ],
)
def test_parsed_path(spark, path, expected):
    df = spark.createDataFrame([(path,)], "path string")
    assert tuple(df.select(names.parsed_path("path").alias("p")).first()["p"]) == expected


def test_stored_names(spark):
    df = spark.createDataFrame([("plan.csv",)], "n string")
    form, again, upload, random_form = df.select(
        names.stored_name_form("n", F.lit("seed")),
        names.stored_name_form("n", F.lit("seed")),
        names.stored_name_upload("n", F.lit("seed")),
        names.stored_name_form("n"),
    ).first()
    assert form == again != random_form
    assert len(form) == len(random_form) == 36 + 1 + len("plan.csv")
    assert form.endswith("_plan.csv") and upload.endswith(".csv") and len(upload) == 36


def test_bytes_base_names_and_classes(spark):
    df = spark.createDataFrame([("é", r"C:\x\y.csv", "SUBMITTED")], "t string, p string, s string")
    got = df.select(
        names.size_bytes("t"),
        names.base_name("p"),
        names.status_class("s"),
        names.relative_path(F.lit("hdfs://h/mnt/uploads/3/3_gps_a b.csv")),
        names.relative_path(F.lit("other/3_gps_a.csv")),
    ).first()
    assert tuple(got) == (2, "y.csv", "status-submitted", "uploads/3/3_gps_a b.csv", "other/3_gps_a.csv")
    assert rows(df.select(names.or_empty(F.lit(None)))) == [("",)]
