import json
from datetime import datetime

from pyspark.sql import functions as F
from tests.helpers import plan, rows

from loadweave import schemas
from loadweave.functions.ordered import next_id
from loadweave.operators import intake, quality, relations
from loadweave.session import pin
from loadweave.sources import landing, tables

NOW = datetime(2026, 1, 1, 12)


def file(name, size=3, kind="text/csv"):
    return {"filename": name, "content_type": kind, "size": size}


def form(key, **extra):
    base = {"submission_id": key, "company_name": "شرکت", "contact_name": "c", "mobile": "+98 0912"}
    return {**base, **extra}


FORMS = [
    form(
        "b",
        orders_file=file("orders 1%.csv"),
        fleet_file=file(""),
        gps_file=file("track.gpx", size=0),
        other_files=[file("same.txt"), file("same.txt"), None, file(None)],
        email=None,
        goal="",
    ),
    form("a", email="x@y.example", industry="food"),
    form("c", company_name=""),
    form("d", mobile=None, contact_name="n" * 201),
    form("e", orders_file=file("../../etc/passwd"), drivers_file=file("folder/"), gps_file=file("n" * 219)),
]


def landed(spark, tmp_path):
    path = tmp_path / "forms.json"
    # one accepted and one rejected submission land twice, two have no id, two lines are broken
    lines = [json.dumps(f) for f in [*FORMS, FORMS[0], FORMS[2], form(None), form("")]]
    path.write_text("\n".join([*lines, '{"submission_id": "z', "no json"]), encoding="utf-8")
    return landing.read_submissions(spark, str(path))


def test_intake_end_to_end(spark, tmp_path):
    requests, files, rejected, bad_files = intake.intake(landed(spark, tmp_path), NOW, 10, 50, "r1")
    assert requests.schema == schemas.REQUESTS or requests.columns == schemas.REQUESTS.names
    got = {r["id"]: r for r in requests.collect()}
    assert sorted(got) == [10, 11, 12]
    assert got[10]["email"] == "x@y.example" and got[10]["goal"] == ""
    assert got[11]["email"] == "" and got[11]["status"] == "SUBMITTED"
    assert got[11]["mobile"] == "+98 0912"

    broken = "line:unreadable submission_id:required company_name:required contact_name:required mobile:required"
    assert rows(rejected, "submission_id", "raw_text", F.array_join("reasons", " ")) == sorted(
        [
            ("c", None, "company_name:required"),
            ("d", None, "contact_name:length mobile:required"),
            (None, None, "submission_id:required"),
            ("", None, "submission_id:required"),
            (None, '{"submission_id": "z', broken),
            (None, "no json", broken),
        ],
        key=repr,
    )
    assert rows(files, "request_id", "file_type", "original_name", "file_size") == sorted(
        [
            (11, "orders", "orders 1%.csv", 3),
            (11, "gps", "track.gpx", 0),
            (11, "other", "same.txt", 3),
            (11, "other", "same.txt", 3),
            (12, "orders", "passwd", 3),
        ],
        key=repr,
    )
    # an empty name after the folder is cut off, and a name too long once prefixed
    assert rows(bad_files, "request_id", "file_type", F.array_join("reasons", " ")) == [
        (12, "drivers", "original_name:required"),
        (12, "gps", "stored_name:length"),
    ]
    ids = [r[0] for r in rows(files, "id")] + [r[0] for r in rows(bad_files, "id")]
    assert sorted(ids) == list(range(50, 57))
    assert files.select("stored_name").distinct().count() == 5
    assert rows(relations.path_collisions(files), "file_path", "writers") == [
        ("uploads/11/11_other_same.txt", 2)
    ]


def test_a_retry_gives_the_same_rows(spark, tmp_path):
    def run():
        requests, files, *_ = intake.intake(landed(spark, tmp_path), NOW, run="r1")
        return rows(requests), rows(files)

    assert run() == run()


def test_every_landed_row_is_accounted_for(spark, tmp_path):
    lines = landed(spark, tmp_path)
    requests, _, rejected, _ = intake.intake(lines, NOW)
    repeats = 2
    assert requests.count() + rejected.count() + repeats == lines.count() == 11


def test_of_unequal_copies_one_is_chosen_by_a_fixed_rule(spark):
    copies = [form("x", goal=str(i)) for i in range(20)] + [form("x", mobile="")]
    texts = [json.dumps(c) for c in copies]

    def outcome(order, parts):
        df = spark.createDataFrame([(t,) for t in order], "value string").repartition(parts)
        requests, files, rejected, _ = intake.intake(landing.parse_submissions(df, "value"), NOW)
        assert requests.count() + rejected.count() == 1
        return rows(requests, "goal") + rows(rejected, "submission_id")

    assert outcome(texts, 1) == outcome(texts[::-1], 3) == outcome(texts[7:] + texts[:7], 5)


def test_copies_do_not_gather_texts(spark):
    # a third of the landed rows are copies of one submission
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("submission_id"),
        *[F.lit("x").alias(c) for c in ("company_name", "contact_name", "mobile", "email", "industry")],
        F.when(F.col("id") % 3 == 0, "text").otherwise(F.col("id").cast("string")).alias("goal"),
    )
    numbered = pin(intake.numbered(df))
    once = intake.one_of_each(intake.check_submissions(numbered))
    assert "SortAggregate" not in plan(once)
    requests = intake.request_rows(once, NOW)
    assert requests.count() == 2001
    assert rows(requests.agg(F.min("id"), F.max("id"), F.count_distinct("id"))) == [(1, 2001, 2001)]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    table = str(tmp_path / "files")
    _, files, *_ = intake.intake(landed(spark, tmp_path), NOW)
    for batch in (0, 0, 1):
        tables.append_batch(files, table, batch, ["file_type"])
    back = tables.read_table(spark, table)
    assert back.groupBy("batch").count().count() == 2
    assert back.filter("batch = 0").count() == files.count()
    assert next_id(back) == files.agg(F.max("id")).first()[0] + 1
    assert next_id(back.limit(0)) == 1


def test_slots_keep_order_and_empty_files(spark, tmp_path):
    one = landed(spark, tmp_path).filter("submission_id = 'b'").limit(1)
    slots = intake.slot_unpivot(one, "submission_id")
    assert [r[0] for r in slots.orderBy("position").select("file_type").collect()] == [
        "orders", "fleet", "drivers", "gps", "other", "other", "other", "other",
    ]
    kept = intake.slot_filter(slots).orderBy("position").select("position", "file.size").collect()
    assert [tuple(r) for r in kept] == [(0, 3), (3, 0), (4, 3), (5, 3)]


UPLOADS = "upload_id string, request_id long, position int, file_type string, filename string, content_type string, size long"


def test_uploads_end_to_end(spark):
    uploads = spark.createDataFrame(
        [
            ("u1", 5, 0, "gps", "a.gpx", None, 4),
            ("u1", 5, 1, "maps", "b", "x/y", None),
            ("u2", 6, 0, "gps", "c.d", None, 1),
            ("u3", 5, 0, "gps", "a.gpx", None, 9),
            ("u3", 99, 1, "gps", "a.gpx", None, 9),
        ],
        UPLOADS,
    )
    requests = spark.createDataFrame([(5,), (6,)], "id long")
    stored, orphans, rejected, receipts = intake.upload_intake(uploads, requests, NOW, 998)
    assert rows(stored, "id", "file_size") == [(1000, 1), (1001, 9), (998, 4)]
    assert rows(orphans, "id") == [(1002,)]
    assert rows(rejected, "id", F.array_join("reasons", " ")) == [(999, "file_type:domain")]
    for path, name in rows(stored, "file_path", "stored_name"):
        assert path.endswith("/" + name)
    # the same file uploaded again does not overwrite the first
    assert stored.select("file_path").distinct().count() == 3
    answers = {r["upload_id"]: json.loads(r["receipt"]) for r in intake.receipt_json(receipts).collect()}
    assert sorted(answers) == ["u1", "u2", "u3"]
    assert answers["u1"]["success"] is True
    assert [list(f) for f in answers["u1"]["files"]] == [["id", "original_name", "stored_name", "file_type"]]


def test_pages_are_bounded_and_whole(spark):
    files = spark.range(10_000).select(
        "id", F.lit(1).cast("long").alias("request_id"), F.lit("x").alias("file_type")
    )
    pages = relations.file_pages(files, 64, "file_type")
    sizes = pages.agg(F.max(F.size("files")), F.sum(F.size("files"))).first()
    assert tuple(sizes) == (64, 10_000) and pages.count() == -(-10_000 // 64)


def test_interleaved_requests_have_one_page_each(spark):
    files = spark.range(10_000).select(
        "id", (F.col("id") % 150).alias("request_id"), F.lit("x").alias("file_type")
    )
    assert relations.file_pages(files, 1000, "file_type").count() == 150


def test_projects(spark):
    good = "توزیع فوری"
    df = spark.createDataFrame(
        [("p", "c", good, "25", None), ("q", "c", good, "", "d"), ("r", "c", "weekly", "x", "d"), ("", "c", good, "1", "d")],
        schemas.PROJECT_FORM,
    )
    ok, bad = intake.project_intake(df)
    assert rows(ok, "name", "fleet_size", "description") == [("p", 25, ""), ("q", None, "d")]
    assert rows(bad, "name", F.array_join("reasons", " ")) == [
        ("", "name:required"),
        ("r", "scenario:domain fleet_size:type"),
    ]
