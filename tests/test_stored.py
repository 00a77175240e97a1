"""Stored tables: deletes, lookups and joins through their layout, changes in the catalogue, one-pass writes."""

import random
import re
from datetime import datetime
from uuid import uuid4

import pytest
from pyspark.sql import functions as F
from tests.helpers import plan, rows, settings

from loadweave import schemas
from loadweave.operators import change, quality, relations
from loadweave.sources import tables


def stored_files(folder):
    """Path below the folder and time of change of every data file."""
    return {
        str(p.relative_to(folder)): p.stat().st_mtime_ns
        for p in folder.rglob("*.parquet")
    }


def request_rows(spark, n=400):
    # statuses F (a third of all), O, P and a NULL one
    kind = F.when(F.col("id") % 3 == 0, "F").when(F.col("id") % 50 == 7, F.lit(None)).otherwise(
        F.when(F.col("id") < n // 2, "O").otherwise("P=1 %")
    )
    return spark.range(0, n).select("id", F.concat(F.lit("09"), F.hash("id")).alias("mobile"), kind.alias("status"))


def file_rows(spark, n=1200):
    return spark.range(0, n).select(
        "id", (F.col("id") % 400).alias("request_id"), F.when(F.col("id") % 400 < 100, "gps").otherwise("fleet").alias("file_type")
    )


@pytest.fixture
def written(spark, tmp_path):
    requests, files = tmp_path / "requests", tmp_path / "files"
    tables.write_requests(request_rows(spark), str(requests))
    tables.write_request_files(file_rows(spark), str(files))
    return requests, files


def delete(spark, written, condition):
    doomed = spark.read.parquet(str(written[0])).filter(condition).select("id")
    tables.delete_requests(spark, *map(str, written), doomed)


def test_delete_rewrites_touched_partitions_only(spark, written):
    before = [stored_files(f) for f in written]
    # requests 3 and 30 are F, their files gps
    delete(spark, written, "id IN (3, 30)")
    after = [stored_files(f) for f in written]
    for old, new, touched in zip(before, after, ("status=F", "file_type=gps"), strict=True):
        same = {k: v for k, v in old.items() if not k.startswith(touched)}
        assert same and same == {k: v for k, v in new.items() if not k.startswith(touched)}
        assert not set(old) & {k for k in new if k.startswith(touched)}
    requests, files = (spark.read.parquet(str(f)) for f in written)
    expected, kept, _ = relations.cascade_delete(
        request_rows(spark), file_rows(spark), spark.createDataFrame([(3,), (30,)], "id long")
    )
    assert rows(requests, "id", "mobile", "status") == rows(expected, "id", "mobile", "status")
    assert rows(files, "id", "request_id", "file_type") == rows(kept, "id", "request_id", "file_type")


def test_delete_of_whole_partitions_and_odd_values(spark, written):
    delete(spark, written, "status IS NULL OR status = 'P=1 %'")
    requests, files = (spark.read.parquet(str(f)) for f in written)
    assert {p.name for p in written[0].iterdir() if p.is_dir()} == {"status=F", "status=O"}
    gone = request_rows(spark).filter("status IS NULL OR status = 'P=1 %'")
    expected, kept, _ = relations.cascade_delete(request_rows(spark), file_rows(spark), gone)
    assert rows(requests, "id") == rows(expected, "id")
    assert rows(files, "id") == rows(kept, "id")
    # again, and with ids that nothing has: no file changes
    before = [stored_files(f) for f in written]
    tables.delete_requests(spark, *map(str, written), gone.select("id").union(spark.range(5000, 5001)))
    assert [stored_files(f) for f in written] == before


def test_deleted_files_go_first(spark, written, monkeypatch):
    def fail(*_):
        raise RuntimeError("the cluster is gone")

    # breaks off before the requests are rewritten: no file is without its request
    monkeypatch.setattr(tables, "_requests_writer", fail)
    with pytest.raises(RuntimeError):
        delete(spark, written, "id = 3")
    requests, files = (spark.read.parquet(str(f)) for f in written)
    assert relations.fk_orphans(files, requests).count() == 0
    assert files.filter("request_id = 3").count() == 0 and requests.filter("id = 3").count() == 1
    monkeypatch.undo()
    delete(spark, written, "id = 3")
    assert spark.read.parquet(str(written[0])).filter("id = 3").count() == 0


def scanned_rows(df):
    """Rows that the scans of a plan that has run gave out."""
    text = df._jdf.queryExecution().executedPlan()
    leaves = text.collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.nodeName().startswith("AQEShuffleRead"):
            continue
        metrics = leaf.metrics()
        if metrics.contains("numOutputRows"):
            total += metrics.apply("numOutputRows").value()
    return total


def test_a_mobile_is_looked_up_in_few_row_groups(spark, tmp_path):
    # mobiles in no order, so that smallest and largest values of a row group say nothing
    df = spark.range(0, 40_000).select(
        "id", F.lpad(F.abs(F.hash("id")).cast("string"), 12, "0").alias("mobile"), F.lit("O").alias("status")
    )
    wanted = df.filter("id = 12345").first().mobile
    path = str(tmp_path / "requests")
    with settings(spark, spark__sql__shuffle__partitions="8", spark__sql__adaptive__coalescePartitions__enabled="false"):
        tables.write_requests(df, path, bloom_values=5000)

    def looked_up():
        found = tables.by_mobile(spark, path, wanted)
        assert [r.id for r in found.collect()] == [12345]
        return scanned_rows(found)

    assert spark.read.parquet(path).select(F.col("_metadata.file_path")).distinct().count() == 8
    assert looked_up() <= 10_000
    # without the filters of the row groups all of them are read
    with settings(spark, **{"parquet__filter__bloom__enabled": "false", "parquet__filter__dictionary__enabled": "false"}):
        assert looked_up() == 40_000


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    requests, files = f"r_{uuid4().hex}", f"f_{uuid4().hex}"
    left = request_rows(spark)
    right = file_rows(spark).withColumn("file_size", F.col("id") % 7)
    tables.write_bucketed(left, requests, "id", 8, ["id"], str(tmp_path / "r"))
    tables.write_bucketed(right, files, "request_id", 8, ["request_id"], str(tmp_path / "f"))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        found = relations.request_with_files(spark.table(requests), spark.table(files))
        got = rows(found)
        assert "Exchange" not in plan(found) and "SortMergeJoin" in plan(found)
        assert got == rows(relations.request_with_files(left, right))


def test_a_column_is_added_without_rewriting(spark, tmp_path):
    requests, files = f"r_{uuid4().hex}", f"f_{uuid4().hex}"
    folder = tmp_path / "requests"
    early = spark.createDataFrame([(1, "F"), (2, None)], "id long, status string")
    early.write.option("path", str(folder)).saveAsTable(requests)
    before = stored_files(folder)
    change.evolve_table_up(spark, requests, files, str(tmp_path / "files"), datetime(2026, 1, 1, 12))
    assert stored_files(folder) == before
    spark.sql(f"INSERT INTO {requests} VALUES (3, 'O', TIMESTAMP '2027-01-01 00:00:00Z')")
    spark.sql(f"INSERT INTO {requests} (id, status) VALUES (4, 'P')")
    assert {k: v for k, v in stored_files(folder).items() if k in before} == before
    noon, later = 1_767_268_800, 1_798_761_600
    assert rows(spark.table(requests).select("id", F.unix_seconds("updated_at"))) == [
        (1, noon), (2, noon), (3, later), (4, noon)
    ]
    created = spark.table(files)
    assert created.count() == 0 and created.columns == schemas.REQUEST_FILES.names
    assert [f.dataType for f in created.schema] == [f.dataType for f in schemas.REQUEST_FILES]


def test_checks_and_counts_take_one_pass(spark, tmp_path):
    df = spark.range(0, 1000).select(
        "id", F.when(F.col("id") % 4 > 0, "x").alias("name"), F.when(F.col("id") % 6 > 0, "").otherwise("y").alias("code")
    )
    df.write.parquet(str(tmp_path / "in"))
    checked = quality.required_check(spark.read.parquet(str(tmp_path / "in")), ["name", "code"])
    counted = quality.write_by_outcome(checked, str(tmp_path / "out"), ["name:required", "code:required"])
    executions = spark._jsparkSession.sharedState().statusStore().executionsList()
    text = executions.last().physicalPlanDescription()
    assert "CollectMetrics" in text and len(re.findall(r"\n\(\d+\) Scan parquet", text)) == 1
    out = spark.read.parquet(str(tmp_path / "out"))
    broken = out.filter("outcome = 'rejected'")
    assert counted == {
        "rows": out.count(),
        "rejected": broken.count(),
        "name:required": broken.filter(F.array_contains("reasons", "name:required")).count(),
        "code:required": broken.filter(F.array_contains("reasons", "code:required")).count(),
    }
    assert counted["rows"] == 1000 and 0 < counted["rejected"] < 1000
    valid, rejected = quality.split_valid(checked)
    assert rows(out.filter("outcome = 'valid'"), "id") == rows(valid, "id")
    assert rows(broken, "id") == rows(rejected, "id")
    none = quality.write_by_outcome(checked.limit(0), str(tmp_path / "none"))
    assert none == {"rows": 0, "rejected": 0}


def two_sides(spark, changes=12, n=3000):
    """Files on disk and rows of the catalogue that agree but for some."""
    rng = random.Random(4)
    paths = [f"uploads/{i}/{i}_gps_a.csv" for i in range(n)]
    disk = [(f"file:/mnt/{p}", i % 90) for i, p in enumerate(paths)]
    files = [(i, p, i % 90) for i, p in enumerate(paths)]
    # written twice, the last one counts
    files += [(n + i, paths[i], i % 90) for i in range(0, 40)]
    files[7:7] = [(-1, paths[50], 5_000)]
    for k in rng.sample(range(100, n), changes):
        if k % 3 == 0:
            disk[k] = None
        elif k % 3 == 1:
            files[k] = None
        else:
            disk[k] = (disk[k][0], 1000)
    odd = [(None, 3), ("/elsewhere/x", 4), ("file:/mnt/uploads/1000000/a", None)]
    disk = [x for x in disk if x] + (odd if changes else [])
    files = [x for x in files if x]
    files += [(9_999, None, 3), (9_998, "archive/y", 1), (9_997, "uploads/1000000/a", 0)] if changes else []
    return (
        spark.createDataFrame(disk, "path string, size long"),
        spark.createDataFrame(files, "id long, file_path string, file_size long"),
    )


@pytest.mark.parametrize("buckets", [1, 64, 4096])
def test_digests_give_the_same_classes(spark, buckets):
    disk, files = two_sides(spark)
    found = quality.reconcile_by_digest(disk, files, buckets)
    assert rows(found) == rows(quality.storage_reconcile(disk, files))


def test_equal_buckets_send_no_rows_to_the_join(spark):
    def joined(changes):
        disk, files = two_sides(spark, changes)
        with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false"):
            found = quality.reconcile_by_digest(disk, files, 512)
            n = found.count()
            assert n == quality.storage_reconcile(disk, files).count()
            sides = quality._on_disk(disk), quality._catalogued(files)
            placed = [s.withColumn("_bucket", F.pmod(F.xxhash64("path"), F.lit(512))) for s in sides]
            differ = quality.unequal_buckets(*[s.filter("path IS NOT NULL") for s in placed], 512)
            return [s.join(differ, "_bucket", "left_semi").count() for s in placed], n

    # nothing at all where the sides are equal, a few buckets of some six paths each where they are not
    assert joined(0)[0] == [0, 0]
    (disk, files), n = joined(12)
    assert 0 < disk < n / 10 and 0 < files < n / 10
