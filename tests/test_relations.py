from datetime import datetime

from pyspark.sql import functions as F
from tests.helpers import plan, rows, settings

from loadweave import schemas
from loadweave.operators import listing, relations, reports

SMALL_SKEW = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "20KB",
    "spark__sql__adaptive__coalescePartitions__minPartitionSize": "1KB",
}


def hot_files(spark, n=60_000):
    """A third of all files belong to request 0 and one path."""
    hot = F.col("id") % 3 == 0
    return spark.range(0, n, 1, 8).select(
        "id",
        F.when(hot, 0).otherwise(F.col("id") % 500).cast("long").alias("request_id"),
        F.lit("gps").alias("file_type"),
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("original_name"),
        F.when(hot, F.lit("uploads/0/p")).otherwise(F.concat(F.lit("u/"), (F.col("id") % 9000).cast("string"))).alias("file_path"),
        F.col("id").alias("file_size"),
    )


def parents(spark, n=400):
    return spark.range(0, n, 1, 4).select("id", F.lit("c").alias("company_name"))


def splits_skew(df):
    df._jdf.queryExecution().toRdd().count()
    return "skew=true" in plan(df)


def test_hot_keys_are_split_in_joins(spark):
    files, known = hot_files(spark), parents(spark)
    with settings(spark, **SMALL_SKEW):
        assert splits_skew(relations.fk_orphans(files, known))
        assert splits_skew(relations.path_collisions(files))
        _, kept, removed = relations.cascade_delete(known, files, known.filter("id < 50"))
        assert splits_skew(kept)
        assert splits_skew(removed)


def test_hot_keys_give_whole_results(spark):
    files = hot_files(spark)
    with settings(spark, **SMALL_SKEW):
        lost = relations.path_collisions(files)
        paths = files.select("file_path").distinct().count()
        assert lost.count() == files.count() - paths
        assert lost.filter("file_path = 'uploads/0/p'").count() == 19_999
        lists = relations.request_file_lists(parents(spark, 600), files, 100)
        whole = lists.agg(F.sum(F.size("files")), F.max(F.size("files")), F.count_distinct("request_id"))
        assert tuple(whole.first()) == (60_000, 100, 600)


def test_requests_without_files_stay(spark):
    files = spark.createDataFrame([(1, 1, 10), (2, 1, 0)], "id long, request_id long, file_size long")
    got = relations.request_with_files(parents(spark, 3), files)
    assert rows(got, "id", "files", "bytes") == [(0, 0, 0), (1, 2, 10), (2, 0, 0)]


def test_orphans_and_cascade(spark):
    files = spark.createDataFrame([(1, 1), (2, 7), (3, 2)], "id long, request_id long")
    known = parents(spark, 3)
    assert rows(relations.fk_orphans(files, known), "id") == [(2,)]
    doomed = spark.createDataFrame([(1,), (1,)], "id long")
    requests, kept, removed = relations.cascade_delete(known, files, doomed)
    assert rows(requests, "id") == [(0,), (2,)]
    assert rows(kept, "id") == [(2,), (3,)]
    assert rows(removed, "id") == [(1,)]


def test_page_is_a_top_k_and_lookup_is_pushed_down(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumnRenamed("o_orderkey", "id")
    assert "TakeOrderedAndProject" in plan(listing.request_page(orders, 5, 100))
    assert "GreaterThan" not in plan(listing.request_page(orders, 5))
    assert "EqualTo(o_orderkey,7)" in plan(listing.request_lookup(orders, 7))
    pages, last = [], None
    while True:
        page = [r["id"] for r in listing.request_page(orders, 400, last).collect()]
        if not page:
            break
        pages += page
        last = page[-1]
    assert pages == [r["id"] for r in listing.request_list(orders).collect()]


def test_admin_view_reads_three_columns(spark, tmp_path):
    path = str(tmp_path / "r")
    parents(spark, 5).withColumns({"status": F.lit("S"), "goal": F.lit("g")}).write.parquet(path)
    view = listing.admin_view(spark.read.parquet(path))
    assert [tuple(r) for r in view.collect()][0] == (4, "c", "S")
    assert "goal" not in plan(view)


def test_kpis_and_fallback(spark):
    orders = spark.createDataFrame([("a", "O"), ("a", "F"), ("b", "O"), (None, "O")], "company string, status string")
    kpis = reports.kpi_counts(parents(spark, 3), orders, parents(spark, 2), "O")
    assert tuple(kpis.first()) == (3, 2, 3, 2)
    assert tuple(reports.kpi_fallback(kpis).first()) == (3, 2, 3, 2)
    assert tuple(reports.kpi_fallback(kpis.limit(0)).first()) == (12, 8, 1540, 47)
    part = kpis.drop("orders").withColumn("vehicles", F.lit(None).cast("long"))
    assert tuple(reports.kpi_fallback(part).first()) == (3, 2, 1540, 47)
    assert "Cartesian" not in plan(kpis) and "Join" not in plan(kpis)


def test_company_table_is_complete(spark):
    now = datetime(2026, 1, 1)
    names = [("A",), (" A ",), ("a",), ("",), (None,), ("D",)]
    df = spark.createDataFrame(names, "company_name string")
    assert rows(reports.company_dim(df, None, now), "id", "name", "code") == [
        (1, "A", None), (2, "D", None), (3, "a", None)
    ]
    known = spark.createDataFrame(
        [(7, "A", "C1"), (9, "B", "C2"), (8, "B", "C3")], "id long, name string, code string"
    ).withColumns({c: F.lit("2024-01-01").cast("timestamp") for c in ("created_at", "updated_at")})
    got = reports.company_dim(df, known, now)
    assert got.columns == schemas.COMPANIES.names
    # known companies stay, one row per name; new ones follow the largest id
    assert sorted(rows(got, "id", "name", "code", F.year("created_at"))) == [
        (7, "A", "C1", 2024), (8, "B", "C3", 2024), (10, "D", None, 2026), (11, "a", None, 2026)
    ]


def test_intake_stats_cover_all_types(spark):
    files = spark.createDataFrame([(1, "gps", 5), (1, "maps", 2)], "request_id long, file_type string, file_size long")
    got = reports.intake_stats(files).first().asDict()
    assert (got["files"], got["bytes"], got["gps_files"], got["gps_bytes"], got["orders_files"]) == (2, 7, 1, 5, 0)
