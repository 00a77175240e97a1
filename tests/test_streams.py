import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from tests.helpers import plan, rows, settings

from loadweave import schemas
from loadweave.operators import relations, reports
from loadweave.plans import standins
from loadweave.sources import landing
from loadweave.streaming import feeds

SF = "/root/testdata/sf0.001"


def split_events(spark, folder, parts=3):
    events = standins.table(spark, SF, "events")
    for part in range(parts):
        events.filter(F.col("event_id") % parts == part).coalesce(1).write.mode("append").parquet(folder)
        yield part


def run_status(spark, root, per_batch=None):
    events = standins.table(spark, SF, "events")
    feed = standins.as_status_feed(
        feeds.file_feed(spark, f"{root}/in", events.schema, files_per_batch=per_batch)
    )
    query = feeds.start_latest_status(feed, f"{root}/log", f"{root}/cp")
    query.awaitTermination()


def test_latest_status_survives_restarts(spark, tmp_path):
    root = str(tmp_path)
    for _ in split_events(spark, f"{root}/in"):
        run_status(spark, root)
    batch = reports.latest_status(standins.status_feed(spark, SF))
    assert rows(feeds.read_latest_status(spark, f"{root}/log")) == rows(batch)
    assert spark.read.parquet(f"{root}/log/batches").select("batch").distinct().count() == 3


def test_latest_status_in_many_batches(spark, tmp_path):
    root = str(tmp_path)
    for _ in split_events(spark, f"{root}/in"):
        pass
    run_status(spark, root, per_batch=1)
    batch = reports.latest_status(standins.status_feed(spark, SF))
    assert rows(feeds.read_latest_status(spark, f"{root}/log")) == rows(batch)


def test_intake_takes_each_file_once(spark, tmp_path):
    root = str(tmp_path)
    events = standins.table(spark, SF, "events")
    known = standins.table(spark, SF, "supplier").select(F.col("s_suppkey").alias("id"))
    known.write.parquet(f"{root}/requests")
    for part in split_events(spark, f"{root}/in"):
        if part == 1:  # land one part twice
            events.filter("event_id % 3 = 0").coalesce(1).write.mode("append").parquet(f"{root}/in")
        rows_in = feeds.file_feed(spark, f"{root}/in", events.schema).select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("request_id"),
            F.col("event_type").alias("file_type"),
        )
        feeds.start_intake(
            rows_in,
            lambda: spark.read.parquet(f"{root}/requests"),
            f"{root}/files",
            f"{root}/cp",
        ).awaitTermination()
    files = events.select(F.col("event_id").alias("id"), F.col("user_id").alias("request_id"))
    orphans = relations.fk_orphans(files, known)
    taken = feeds.read_intake(spark, f"{root}/files", known=True)
    lost = feeds.read_intake(spark, f"{root}/files", known=False)
    assert rows(lost, "id") == rows(orphans, "id")
    assert taken.count() + lost.count() == events.count()
    assert taken.select("id").distinct().count() == taken.count()


def test_kpis_match_the_batch(spark, tmp_path):
    root = str(tmp_path)
    orders, nation, supplier = (standins.table(spark, SF, t) for t in ("orders", "nation", "supplier"))
    orders.repartition(5).write.parquet(f"{root}/in")
    stream = feeds.file_feed(spark, f"{root}/in", orders.schema, files_per_batch=1)
    feeds.start_kpis(
        stream,
        "O",
        f"{root}/log",
        f"{root}/cp",
        company="o_custkey",
        status="o_orderstatus",
        compact_every=2,
    ).awaitTermination()
    live = feeds.read_kpis(spark, f"{root}/log", nation, supplier)
    batch = reports.kpi_counts(nation, orders, supplier, "O", "o_custkey", "o_orderstatus")
    assert rows(live) == rows(batch)
    assert spark.read.parquet(f"{root}/log/batches").select("batch").distinct().count() == 5
    assert rows(spark.read.parquet(f"{root}/log/state").select("upto").distinct()) == [(1,), (3,)]


def test_folding_the_log_keeps_the_answer(spark, tmp_path):
    root = str(tmp_path)
    for _ in split_events(spark, f"{root}/in", 5):
        pass
    events = standins.table(spark, SF, "events")
    feed = standins.as_status_feed(feeds.file_feed(spark, f"{root}/in", events.schema, files_per_batch=1))
    feeds.start_latest_status(feed, f"{root}/log", f"{root}/cp", compact_every=2).awaitTermination()
    batch = reports.latest_status(standins.status_feed(spark, SF))
    found = feeds.read_latest_status(spark, f"{root}/log")
    assert rows(found) == rows(batch)
    # what was read is the newest state and the one batch after it
    read = {p.split("/log/")[1].split("/part")[0] for p in found.inputFiles()}
    assert read <= {"state/upto=3", "batches/batch=4"} or "PartitionFilters: [isnotnull(upto" in plan(found)


def test_landed_bytes_as_a_stream(spark, tmp_path):
    folder = tmp_path / "uploads" / "4"
    folder.mkdir(parents=True)
    (folder / "4_gps_a.gpx").write_bytes(b"12345")
    schema = spark.read.format("binaryFile").load(str(folder)).schema
    feed = feeds.file_feed(spark, str(tmp_path / "uploads"), schema, "binaryFile")
    out = str(tmp_path / "out")
    (
        feed.select("path", F.col("length").alias("size"))
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start(out)
        .awaitTermination()
    )
    assert rows(spark.read.parquet(out), "size") == [(5,)]


def test_submissions_keep_ids_dense_over_batches(spark, tmp_path):
    root, landing = str(tmp_path), tmp_path / "landing"
    landing.mkdir()

    def form(key, **extra):
        slot = {"filename": "a.csv", "content_type": None, "size": 1}
        base = {"submission_id": key, "company_name": "c", "contact_name": "c", "mobile": "1"}
        return json.dumps({**base, "orders_file": slot, **extra})

    bad_slot = {"filename": "x" * 250, "content_type": None, "size": 1}
    batches = [
        [form("a"), form("b", gps_file=bad_slot), form("bad", mobile=""), form(None)],
        [form("a"), form("c"), "half a line", form(None)],
        [form("e"), form("d"), form("d"), form("bad")],
    ]
    for n, lines in enumerate(batches):
        (landing / f"{n}.json").write_text("\n".join(lines))
        feed = feeds.file_feed(spark, str(landing), schemas.LANDED, "json")
        feeds.start_submissions(
            feed, lambda: datetime(2026, 1, 1), f"{root}/t", f"{root}/cp"
        ).awaitTermination()
    requests = spark.read.parquet(f"{root}/t/requests")
    # the rejected one lands again corrected, and is taken
    assert rows(requests, "batch", "id") == [(0, 1), (0, 2), (1, 3), (2, 4), (2, 5), (2, 6)]
    files = spark.read.parquet(f"{root}/t/files")
    bad = spark.read.parquet(f"{root}/t/rejected_files")
    assert sorted(rows(files, "id") + rows(bad, "id")) == [(i,) for i in range(1, 8)]
    assert rows(relations.fk_orphans(files, requests)) == []
    # each row without id is a reject of its own, copies of what was taken leave none
    rejected = spark.read.parquet(f"{root}/t/rejected")
    assert rows(rejected, "batch", "submission_id") == sorted(
        [(0, "bad"), (0, None), (1, None), (1, None)], key=repr
    )
    assert rows(spark.read.parquet(f"{root}/t/next_ids"), "batch", "request_id", "file_id") == [
        (0, 3, 4), (1, 4, 5), (2, 7, 8)
    ]


def submission(key, **extra):
    return json.dumps({"submission_id": key, "company_name": "c", "contact_name": "c", "mobile": "1", **extra})


def run_submissions(spark, root, batches):
    """Each list of lines as a batch of a stream that is started anew."""
    landing = root / "landing"
    landing.mkdir(exist_ok=True)
    for lines in batches:
        (landing / f"{len(list(landing.iterdir()))}.json").write_text("\n".join(lines))
        feed = feeds.file_feed(spark, str(landing), schemas.LANDED, "json")
        query = feeds.start_submissions(feed, lambda: datetime(2026, 1, 1), f"{root}/t", f"{root}/cp")
        query.awaitTermination()
    return query


def test_a_corrected_submission_is_taken_later(spark, tmp_path):
    run_submissions(
        spark,
        tmp_path,
        [
            # nothing but rejects: two tables have no rows at all yet
            [submission("7", mobile=None)],
            [submission("7"), submission("7", mobile="")],
            [submission("7"), submission("7", mobile=None), submission("7", goal="g"), submission("7", email="")],
            [submission("7", goal="g"), submission("7", mobile="", goal="h")],
        ],
    )
    requests = feeds.read_submissions(spark, f"{tmp_path}/t", "requests")
    assert rows(requests, "batch", "id", "mobile") == [(1, 1, "1")]
    rejected = feeds.read_submissions(spark, f"{tmp_path}/t", "rejected")
    # exact repeats leave nothing, of unequal copies in a batch there is one
    assert rows(rejected, "batch", F.array_join("reasons", " ")) == [
        (0, "mobile:required"),
        (2, "submission_id:unequal_copy"),
        (3, "mobile:required"),
    ]


def test_tables_without_rows_can_be_read(spark, tmp_path):
    run_submissions(spark, tmp_path, [[submission("1", mobile="")]])
    for table in feeds.SUBMISSION_TABLES:
        found = feeds.read_submissions(spark, f"{tmp_path}/t", table)
        assert found.count() == (table == "rejected")


def test_ids_are_state_and_no_table(spark, tmp_path):
    first = [submission(str(i)) for i in range(20)]
    run_submissions(spark, tmp_path, [first])
    # the tables of the first batch go, but for the next free ids; its ids are known all the same
    kept = tmp_path / "t" / "next_ids"
    for table in (tmp_path / "t").iterdir():
        if table != kept:
            table.rename(tmp_path / f"old_{table.name}")
    query = run_submissions(spark, tmp_path, [[*first, submission("20"), submission("3", goal="g")]])
    assert rows(feeds.read_submissions(spark, f"{tmp_path}/t", "requests"), "id") == [(21,)]
    assert rows(feeds.read_submissions(spark, f"{tmp_path}/t", "rejected"), "submission_id") == [("3",)]
    state = {(s["operatorName"], s["numRowsTotal"]) for s in query.lastProgress["stateOperators"]}
    assert state == {("dedupe", 22), ("dedupe", 21)}
    assert all("rocksdbGetCount" in s["customMetrics"] for s in query.lastProgress["stateOperators"])


def test_file_ids_are_state_and_no_table(spark, tmp_path):
    root = str(tmp_path)
    known = spark.range(3).select("id")
    schema = "id long, request_id long, file_type string"

    def run(rows_in, out):
        spark.createDataFrame(rows_in, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        feed = feeds.file_feed(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema)
        query = feeds.start_intake(feed, lambda: known, out, f"{root}/cp")
        query.awaitTermination()
        return query

    run([(1, 1, "gps"), (2, 9, "gps"), (None, 1, "gps"), (None, 1, "gps")], f"{root}/one")
    # another folder: nothing of the first batch can be read there
    query = run([(1, 1, "gps"), (2, 9, "gps"), (3, 2, "gps"), (None, 1, "gps")], f"{root}/two")
    assert rows(feeds.read_intake(spark, f"{root}/two"), "id", "known") == sorted(
        [(3, True), (None, True)], key=repr
    )
    (state,) = query.lastProgress["stateOperators"]
    assert state["operatorName"] == "dedupe" and state["numRowsTotal"] == 3


def waiting(spark, root, *landed, wait=2):
    """Files and requests (id, request, hour) and (id, hour) that land batch by batch."""
    start = datetime(2026, 1, 1)
    for n, (files, requests) in enumerate(landed):
        spark.createDataFrame(
            [(i, r, "gps", start + timedelta(hours=h)) for i, r, h in files],
            "id long, request_id long, file_type string, arrived_at timestamp",
        ).coalesce(1).write.parquet(f"{root}/files/{n}")
        spark.createDataFrame(
            [(i, start + timedelta(hours=h)) for i, h in requests], "id long, arrived_at timestamp"
        ).coalesce(1).write.parquet(f"{root}/requests/{n}")
        files = spark.readStream.schema("id long, request_id long, file_type string, arrived_at timestamp")
        query = feeds.start_waiting_files(
            files.parquet(f"{root}/files/*"),
            spark.readStream.schema("id long, arrived_at timestamp").parquet(f"{root}/requests/*"),
            timedelta(hours=wait),
            f"{root}/out",
            f"{root}/cp",
        )
        query.awaitTermination()
        yield rows(feeds.read_intake(spark, f"{root}/out"), "id", "known"), query


def test_a_file_waits_for_its_request(spark, tmp_path):
    batches = waiting(
        spark,
        str(tmp_path),
        ([(1, 1, 0), (2, 2, 0), (3, 3, 0), (None, 1, 0)], [(1, 0)]),
        # the request of file 2 comes one batch later, that of file 1 has been there
        ([(4, 1, 1), (1, 1, 1)], [(2, 1)]),
        # too late for file 3, not for 5
        ([(5, 3, 9)], [(3, 9)]),
        ([(6, 1, 30)], [(9, 30)]),
    )
    assert next(batches)[0] == [(1, True), (None, True)]
    assert next(batches)[0] == [(1, True), (2, True), (4, True), (None, True)]
    assert (3, True) not in next(batches)[0]
    found, query = next(batches)
    assert found == sorted([(1, True), (2, True), (3, False), (4, True), (5, True), (6, True), (None, True)], key=repr)
    assert sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]) == 0


def test_files_by_batch_time_are_never_late(spark, tmp_path):
    root = str(tmp_path)
    schema = "id long, request_id long, file_type string"
    for n in range(2):
        spark.createDataFrame([(n, n, "gps")], schema).coalesce(1).write.parquet(f"{root}/files/{n}")
        # the request of file 0 comes with the second batch
        spark.createDataFrame([(i,) for i in ([5], [0, 1])[n]], "id long").coalesce(1).write.parquet(
            f"{root}/requests/{n}"
        )
        query = feeds.start_waiting_files(
            feeds.arriving(spark.readStream.schema(schema).parquet(f"{root}/files/*")),
            feeds.arriving(spark.readStream.schema("id long").parquet(f"{root}/requests/*")),
            timedelta(hours=1),
            f"{root}/out",
            f"{root}/cp",
        )
        query.awaitTermination()
    assert rows(feeds.read_intake(spark, f"{root}/out", known=True), "id") == [(0,), (1,)]


def test_manifest_takes_each_file_once_without_its_bytes(spark, tmp_path):
    folder = tmp_path / "uploads" / "4"
    folder.mkdir(parents=True)

    def run():
        feed = feeds.manifest_feed(spark, str(tmp_path / "uploads"), files_per_batch=2)
        query = feeds.start_manifest(feed, str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination()
        return query

    for n in range(5):
        (folder / f"4_gps_{n}.gpx").write_bytes(b"1" * n)
    query = run()
    assert "content" not in query._jsq.explainInternal(False).split("ReadSchema")[-1]
    (folder / "4_orders_a.csv").write_bytes(b"12")
    run()
    found = spark.read.parquet(str(tmp_path / "out"))
    # the source does not report the empty file
    assert rows(found, "original_name", "size", "file_type", "request_id") == sorted(
        [(f"{n}.gpx", n, "gps", 4) for n in range(1, 5)] + [("a.csv", 2, "orders", 4)]
    )
    # three batches of at most two listed files, then one more
    assert found.select("batch").distinct().count() == 4


def test_what_lies_behind_the_folds_is_removed(spark, tmp_path):
    root = str(tmp_path)
    for _ in split_events(spark, f"{root}/in", 7):
        pass
    events = standins.table(spark, SF, "events")
    feed = standins.as_status_feed(feeds.file_feed(spark, f"{root}/in", events.schema, files_per_batch=1))
    feeds.start_latest_status(
        feed, f"{root}/log", f"{root}/cp", compact_every=2, keep_folds=1
    ).awaitTermination()
    batch = reports.latest_status(standins.status_feed(spark, SF))
    assert rows(feeds.read_latest_status(spark, f"{root}/log")) == rows(batch)
    # folds after batches 1, 3 and 5: the last one stays, and the batches after the one before it
    assert sorted(p.name for p in (tmp_path / "log" / "state").iterdir()) == ["upto=5"]
    assert sorted(p.name for p in (tmp_path / "log" / "batches").iterdir()) == ["batch=4", "batch=5", "batch=6"]


def test_late_rows_are_taken_with_default_settings(spark, tmp_path):
    root = str(tmp_path)
    events = standins.table(spark, SF, "events")
    for part in split_events(spark, f"{root}/in"):
        pass
    # the newest rows land first: by their own times all others would be late
    feed = feeds.file_feed(spark, f"{root}/in", events.schema, files_per_batch=1).select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("request_id"),
        F.col("event_type").alias("file_type"),
        F.col("ts").alias("created_at"),
    )
    known = standins.table(spark, SF, "supplier").select(F.col("s_suppkey").alias("id"))
    feeds.start_intake(feed, lambda: known, f"{root}/files", f"{root}/cp").awaitTermination()
    taken = feeds.read_intake(spark, f"{root}/files")
    assert taken.count() == events.count() and taken.select("id").distinct().count() == events.count()


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for n in range(150):
        folder = tmp_path / "uploads" / str(n) / "cv"
        folder.mkdir(parents=True)
        (folder / "a.txt").write_text("x" * n)
    uploads, out, tracker = str(tmp_path / "uploads"), str(tmp_path / "out"), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "")
    with settings(spark, spark__sql__session__timeZone="Asia/Tokyo"):
        feed = feeds.manifest_feed(spark, uploads)
        assert feed.sparkSession.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    query = feeds.start_manifest(feed, out, str(tmp_path / "cp"))
    query.awaitTermination()
    for group in ("listing", str(query.runId)):
        stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
        tasks = [tracker.getStageInfo(s).numTasks for s in stages]
        assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    # a file without content is left out
    taken = spark.read.parquet(out).select("path", "size")
    assert sorted(r["size"] for r in taken.collect()) == list(range(1, 150))
    assert rows(taken) == rows(landing.binary_files(spark, uploads).select("path", "size"))
