from tests.helpers import rows

from loadweave import schemas
from loadweave.operators import quality


def test_null_keys_are_not_duplicates(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("c", "x"), ("d", "x")], "name string, code string")
    assert rows(quality.unique_check(df, ["code"])) == [("x", 2)]


def test_missing_means_null_or_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "id long, v string")
    ok, bad = quality.split_valid(quality.required_check(df, ["v"]))
    assert rows(ok, "id") == [(3,)] and rows(bad, "id") == [(1,), (2,)]


def test_domain_lists_unknown_values(spark):
    df = spark.createDataFrame([("orders",), ("maps",), ("maps",), (None,)], "file_type string")
    assert rows(quality.domain_check(df, "file_type", ["orders"])) == [("maps", 2)]


def test_lengths_count_characters(spark):
    df = spark.createDataFrame([(1, "é" * 5, "ab"), (2, "é" * 6, "abc")], "id long, a string, b string")
    assert rows(quality.length_check(df, "id", {"a": 5, "b": 2})) == [(2, "a", 6, 5), (2, "b", 3, 2)]


def test_types(spark):
    df = spark.createDataFrame(
        [("1", 5), ("x", 2**31), ("", 2**31 - 1), (None, None)], "request_id string, file_size long"
    )
    got = rows(quality.type_check(df, "request_id", {"request_id": "int", "file_size": "int"}))
    assert got == [("x", "file_size", "2147483648", "int"), ("x", "request_id", "x", "int")]


def test_profile_follows_the_schema(spark):
    df = spark.createDataFrame(
        [(1, "n" * 256, None), (2, "b", "x"), (3, "", "x"), (3, None, None)],
        "id long, name string, code string",
    )
    got = {r["column"]: tuple(r)[1:] for r in quality.profile_by_schema(df, schemas.COMPANIES).collect()}
    assert got == {"id": (4, 0, 0, 0, 1), "name": (4, 1, 1, 1, 0), "code": (4, 2, 0, 0, 1)}


def test_reconcile_takes_the_last_writer(spark):
    landed = spark.createDataFrame(
        [("file:/m/uploads/1/1_gps_a b%.csv", 5), ("file:/m/uploads/1/1_gps_z.csv", 0), ("file:/m/uploads/2/x", 1)],
        "path string, size long",
    )
    files = spark.createDataFrame(
        [
            (1, "uploads/1/1_gps_a b%.csv", 9),
            (2, "uploads/1/1_gps_a b%.csv", 5),
            (3, "uploads/1/1_gps_z.csv", 0),
            (4, "uploads/3/gone", 7),
        ],
        "id long, file_path string, file_size long",
    )
    found = quality.storage_reconcile(landed, files)
    assert rows(found, "path", "class", "rows") == [
        ("uploads/1/1_gps_a b%.csv", "ok", 2),
        ("uploads/1/1_gps_z.csv", "ok", 1),
        ("uploads/2/x", "bytes_without_row", 0),
        ("uploads/3/gone", "row_without_bytes", 1),
    ]
    assert rows(quality.reconcile_summary(found), "class", "paths") == [
        ("bytes_without_row", 1), ("ok", 2), ("row_without_bytes", 1),
    ]
