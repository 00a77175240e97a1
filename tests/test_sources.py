import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tests.helpers import plan, rows, settings

from loadweave.operators import quality
from loadweave.sources import jdbc, landing, tables

HEX = "0123456789abcdef" * 2


@pytest.fixture
def uploads(tmp_path):
    content = {
        "1/1_orders_سفارش ها.csv": b"abc",
        "1/1_gps_50%.gpx": b"",
        f"2/{HEX}.csv": "é".encode(),
        "3/.keep": b"",
    }
    for name, data in content.items():
        path = tmp_path / "uploads" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path / "uploads")


def test_a_missing_root_is_an_error(spark):
    with pytest.raises(Exception, match="nowhere"):
        landing.list_folders(spark, "/nowhere/uploads").collect()


def test_paths_outside_the_scheme_stay_apart(spark):
    landed = spark.createDataFrame(
        [("file:/mnt/uploads/77/x.txt", 1), ("/elsewhere/a", 2), ("/elsewhere/b", 3)], "path string, size long"
    )
    files = spark.createDataFrame(
        [(1, "archive/c", 4), (2, "archive/d", 5), (3, None, 6)], "id long, file_path string, file_size long"
    )
    found = quality.storage_reconcile(landed, files)
    assert rows(found, "path", "class", "disk_bytes", "row_bytes") == sorted(
        [
            ("uploads/77/x.txt", "bytes_without_row", 1, None),
            ("/elsewhere/a", "unrecognised_path", 2, None),
            ("/elsewhere/b", "unrecognised_path", 3, None),
            ("archive/c", "unrecognised_path", None, 4),
            ("archive/d", "unrecognised_path", None, 5),
            (None, "unrecognised_path", None, 6),
        ],
        key=repr,
    )


def test_listing_keeps_empty_files(spark, uploads):
    manifest = landing.parse_manifest(landing.list_folders(spark, uploads, 3))
    assert rows(manifest.drop("path")) == sorted(
        [
            (3, 1, "form", "orders", "سفارش ها.csv"),
            (0, 1, "form", "gps", "50%.gpx"),
            (2, 2, "upload", None, None),
            (0, 3, "unknown", None, None),
        ],
        key=repr,
    )


def test_listing_reconciles_with_the_catalogue(spark, uploads):
    files = spark.createDataFrame(
        [
            (1, "uploads/1/1_orders_سفارش ها.csv", 3),
            (2, "uploads/1/1_gps_50%.gpx", 1),
            (3, f"uploads/2/{HEX}.csv", 2),
            (4, "uploads/9/9_gps_gone.gpx", 2),
        ],
        "id long, file_path string, file_size long",
    )
    found = quality.storage_reconcile(landing.list_folders(spark, uploads), files)
    assert rows(found, "path", "class") == sorted(
        [
            ("uploads/1/1_orders_سفارش ها.csv", "ok"),
            ("uploads/1/1_gps_50%.gpx", "size_mismatch"),
            (f"uploads/2/{HEX}.csv", "ok"),
            ("uploads/3/.keep", "bytes_without_row"),
            ("uploads/9/9_gps_gone.gpx", "row_without_bytes"),
        ],
        key=repr,
    )


def test_binary_files_read_no_content(spark, uploads):
    found = landing.binary_files(spark, uploads)
    assert "content" not in plan(found)
    manifest = landing.parse_manifest(found)
    assert rows(manifest, "request_id", "size") == [(1, 3), (2, 2)]


def requests(spark):
    return spark.range(0, 4000, 1, 4).select(
        "id",
        F.concat(F.lit("09"), F.col("id").cast("string")).alias("mobile"),
        F.when(F.col("id") % 10 == 0, "DONE").otherwise("SUBMITTED").alias("status"),
    )


def test_request_layout(spark, tmp_path):
    path = str(tmp_path / "requests")
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        tables.write_requests(requests(spark).repartition(4), path, bloom_values=1000)
    back = tables.read_table(spark, path)
    assert rows(back, "id", "mobile", "status") == rows(requests(spark))
    assert "PartitionFilters: [isnotnull(status" in plan(back.filter("status = 'DONE'"))
    # the large status is written by several tasks, and ids do not overlap between files
    spans = []
    for name in glob.glob(f"{path}/status=SUBMITTED/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        stats = meta.row_group(0).column(0).statistics
        spans.append((stats.min, stats.max))
    assert len(spans) > 1
    spans.sort()
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert rows(back.filter("mobile = '0977'"), "id") == [(77,)]


def test_file_layout(spark, tmp_path):
    df = requests(spark).select(
        "id", (F.col("id") % 7).alias("request_id"), F.lit("gps").alias("file_type")
    )
    path = str(tmp_path / "files")
    tables.write_request_files(df, path)
    back = tables.read_table(spark, path)
    assert rows(back, "id", "request_id", "file_type") == rows(df)


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    df = requests(spark)
    for name in ("left_t", "right_t"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        tables.write_bucketed(df, name, "id", 4, ["id"], str(tmp_path / name))
    joined = spark.table("left_t").hint("merge").join(spark.table("right_t"), "id")
    assert "Exchange" not in plan(joined)
    assert joined.count() == 4000
    for name in ("left_t", "right_t"):
        spark.sql(f"DROP TABLE {name}")


def test_jdbc_options_split_the_scan():
    # no database here: the options are checked, the connection is not
    options = jdbc.scan_options("jdbc:x", "requests", 1, 1000, 8, user="u")
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "8"
    assert options["lowerBound"] == "1" and options["upperBound"] == "1000" and options["user"] == "u"
    with pytest.raises(ValueError):
        jdbc.scan_options("jdbc:x", "requests", 5, 5, 8)


def test_session_names_the_shared_folder(spark):
    from loadweave.session import pin, shared_folder

    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == named if named else shared_folder(spark)
    assert pin(spark.range(3)).count() == 3
