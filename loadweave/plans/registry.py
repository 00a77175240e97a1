"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave import schemas
from loadweave.functions import names
from loadweave.functions.ordered import dense_ids
from loadweave.functions.times import utc_instant
from loadweave.operators import allocation, change, intake, listing, quality, relations, reports
from loadweave.plans import standins
from loadweave.session import pin, shared_folder
from loadweave.sources import landing, tables
from loadweave.streaming import feeds

NOW = datetime(2026, 1, 1)
RUN = "run"

_QUERIES = {}


def _register(query):
    _QUERIES[query.__name__] = query
    return query


def all_queries() -> dict:
    return dict(_QUERIES)


def _fresh_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


# ---- requests: lists, lookups, keys -----------------------------------------


@_register
def request_list(spark, sf_dir) -> DataFrame:
    return listing.request_list(standins.requests(spark, sf_dir))


@_register
def request_page(spark, sf_dir) -> DataFrame:
    return listing.request_page(standins.requests(spark, sf_dir), 50, before_id=1200)


@_register
def request_lookup(spark, sf_dir) -> DataFrame:
    return listing.request_lookup(standins.requests(spark, sf_dir), 7)


@_register
def request_lookup_many(spark, sf_dir) -> DataFrame:
    wanted = standins.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return listing.request_lookup_many(standins.requests(spark, sf_dir), wanted)


@_register
def admin_view(spark, sf_dir) -> DataFrame:
    return listing.admin_view(standins.requests(spark, sf_dir))


@_register
def key_assign(spark, sf_dir) -> DataFrame:
    keys = standins.table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return dense_ids(keys, ["o_orderdate", "o_orderkey"])


# ---- intake -------------------------------------------------------------------


def _submissions(spark, sf_dir):
    return landing.parse_submissions(standins.submissions(spark, sf_dir), "value")


@_register
def request_intake(spark, sf_dir) -> DataFrame:
    requests, _, _, _ = intake.intake(_submissions(spark, sf_dir), NOW)
    return requests.select(
        "id",
        "company_name",
        "contact_name",
        "mobile",
        "email",
        "industry",
        F.md5("goal").alias("goal_md5"),
        "status",
        F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("updated_at").alias("updated_us"),
    )


def _outcome(requests, files, rejected, bad_files) -> DataFrame:
    """What an intake has made of its rows, one row each, told apart by ``part``."""
    reasons = F.array_join("reasons", ",")
    none = F.lit(-1).cast("long")
    text = F.coalesce(F.md5(schemas.RAW_TEXT), F.lit(""))
    parts = [
        requests.select(F.lit("request").alias("part"), "id", F.md5("goal").alias("text"), F.lit("").alias("reasons")),
        files.select(F.lit("file").alias("part"), "id", F.col("file_path").alias("text"), F.lit("").alias("reasons")),
        rejected.select(
            F.lit("reject").alias("part"),
            F.coalesce(F.col("submission_id").try_cast("long"), none).alias("id"),
            text.alias("text"),
            reasons.alias("reasons"),
        ),
        bad_files.select(F.lit("file_reject").alias("part"), "id", F.col("file_path").alias("text"), reasons.alias("reasons")),
    ]
    return reduce(DataFrame.unionByName, parts)


@_register
def intake_outcome(spark, sf_dir) -> DataFrame:
    """All that comes of the landed submissions, broken lines and copies among them."""
    texts = standins.rough_submissions(spark, sf_dir)
    return _outcome(*intake.intake(landing.parse_submissions(texts, "value"), NOW, run=RUN))


@_register
def rejected_submissions(spark, sf_dir) -> DataFrame:
    _, rejected = quality.split_valid(intake.check_submissions(_submissions(spark, sf_dir)))
    return rejected.select("submission_id", F.array_join("reasons", ",").alias("reasons"))


def _flat_slots(slots):
    return slots.select(
        "submission_id",
        "position",
        "file_type",
        F.col("file.filename").alias("filename"),
        F.coalesce("file.size", F.lit(-1).cast("long")).alias("size"),
    )


@_register
def slot_unpivot(spark, sf_dir) -> DataFrame:
    return _flat_slots(intake.slot_unpivot(_submissions(spark, sf_dir), "submission_id"))


@_register
def slot_filter(spark, sf_dir) -> DataFrame:
    slots = intake.slot_unpivot(_submissions(spark, sf_dir), "submission_id")
    return _flat_slots(intake.slot_filter(slots))


@_register
def request_file_append(spark, sf_dir) -> DataFrame:
    _, files, _, _ = intake.intake(_submissions(spark, sf_dir), NOW, run=RUN)
    folder = _fresh_folder(spark, "request_files")
    tables.append_batch(files, folder, 0, ["file_type"])
    return _stamped(tables.read_table(spark, folder).drop("batch"))


def _stamped(rows: DataFrame) -> DataFrame:
    """The audit times as microseconds, which mean the same in every zone."""
    return rows.select(
        *[c for c in rows.columns if c not in ("created_at", "updated_at")],
        F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("updated_at").alias("updated_us"),
    )


@_register
def upload_intake(spark, sf_dir) -> DataFrame:
    """events as uploads: one call per user and day, files of unknown requests split off."""
    stored, orphans, rejected, receipts = intake.upload_intake(
        standins.uploads(spark, sf_dir), _parents(spark, sf_dir), NOW
    )
    none = F.lit(-1).cast("long")

    def files(df, part):
        return _stamped(df).select(
            F.lit(part).alias("part"), "upload_id", "id", F.col("file_path").alias("text"), "updated_us"
        )

    answers = intake.receipt_json(receipts).select(
        F.lit("receipt").alias("part"),
        "upload_id",
        F.col("page").alias("id"),
        F.md5("receipt").alias("text"),
        none.alias("updated_us"),
    )
    parts = [files(stored, "file"), files(orphans, "orphan"), files(rejected, "reject"), answers]
    return reduce(DataFrame.unionByName, parts)


@_register
def file_manifest(spark, sf_dir) -> DataFrame:
    return landing.parse_manifest(standins.landed_documents(spark, sf_dir))


@_register
def disk_manifest(spark, sf_dir) -> DataFrame:
    """Suppliers as files, written to the shared folder, listed there and parsed."""
    root = _fresh_folder(spark, "disk").removeprefix("file:")
    written = pin(landing.write_files(standins.supplier_files(spark, sf_dir), root))
    listed = landing.list_folders(spark, f"{root}/uploads")
    manifest = landing.parse_manifest(listed.join(written.select(
        F.concat(F.lit(f"{root}/"), "path").alias("path")), "path", "left_semi"))
    return manifest.withColumn("path", names.relative_path("path"))


@_register
def upload_receipt(spark, sf_dir) -> DataFrame:
    return intake.receipt_json(intake.upload_receipt(standins.request_files(spark, sf_dir)))


@_register
def path_collisions(spark, sf_dir) -> DataFrame:
    return relations.path_collisions(standins.request_files(spark, sf_dir)).select(
        "id", "file_path", "writers", "kept_id"
    )


@_register
def colliding_paths(spark, sf_dir) -> DataFrame:
    return relations.colliding_paths(standins.request_files(spark, sf_dir))


@_register
def project_intake(spark, sf_dir) -> DataFrame:
    accepted, rejected = intake.project_intake(standins.projects(spark, sf_dir))
    none = F.lit(-1)
    rows = accepted.withColumn("reasons", F.lit("")).unionByName(
        rejected.withColumns({"reasons": F.array_join("reasons", ","), "fleet_size": none})
    )
    return rows.select(
        "name",
        "company",
        "scenario",
        F.coalesce("fleet_size", none).alias("fleet_size"),
        F.md5("description").alias("description_md5"),
        "reasons",
    )


# ---- names and values ------------------------------------------------------------


@_register
def stored_name(spark, sf_dir) -> DataFrame:
    pages = standins.page_names(spark, sf_dir)
    seed = F.concat_ws("|", F.lit(RUN), "page_id")
    return pages.select(
        "page_id",
        names.stored_name_form("name", seed).alias("form_name"),
        names.stored_name_upload("name", seed).alias("upload_name"),
    )


@_register
def file_suffix(spark, sf_dir) -> DataFrame:
    return standins.page_names(spark, sf_dir).select(
        "page_id", "name", names.file_suffix("name").alias("suffix")
    )


@_register
def landing_path(spark, sf_dir) -> DataFrame:
    return standins.request_files(spark, sf_dir).select(
        "id",
        names.landing_path_form("request_id", "file_type", "original_name").alias("form_path"),
        names.landing_path_upload("request_id", "stored_name").alias("upload_path"),
    )


@_register
def size_bytes(spark, sf_dir) -> DataFrame:
    return standins.table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", names.size_bytes("text").alias("size_bytes")
    )


@_register
def defaults(spark, sf_dir) -> DataFrame:
    d = standins.labelled_documents(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("toxic") == 1, F.col("lang")).alias("email"),
        F.when(F.col("quality") == 1, F.col("source")).alias("industry"),
        F.lit(None).cast("string").alias("goal"),
        F.when(F.col("quality").isNotNull(), F.lit("CHECKED")).alias("status"),
        F.when(F.col("quality") == 0, F.col("n_chars")).alias("file_size"),
    )
    return intake.with_defaults(d)


@_register
def status_css(spark, sf_dir) -> DataFrame:
    return standins.table(spark, sf_dir, "orders").select(
        "o_orderkey", names.status_class("o_orderstatus").alias("css_class")
    )


# ---- requests and files -------------------------------------------------------------


@_register
def request_with_files(spark, sf_dir) -> DataFrame:
    return relations.request_with_files(
        standins.customers(spark, sf_dir), standins.request_files(spark, sf_dir)
    )


@_register
def request_file_lists(spark, sf_dir) -> DataFrame:
    lists = relations.request_file_lists(
        standins.customers(spark, sf_dir), standins.request_files(spark, sf_dir)
    )
    return lists.withColumn("files", F.to_json("files"))


def _parents(spark, sf_dir):
    return standins.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))


@_register
def fk_orphans(spark, sf_dir) -> DataFrame:
    files = standins.request_files(spark, sf_dir).select("id", "request_id", "file_type")
    return relations.fk_orphans(files, _parents(spark, sf_dir))


@_register
def cascade_delete(spark, sf_dir) -> DataFrame:
    requests, files, removed = relations.cascade_delete(
        standins.customers(spark, sf_dir),
        standins.request_files(spark, sf_dir),
        _parents(spark, sf_dir),
    )
    parts = {"request_kept": requests, "file_kept": files, "file_removed": removed}
    rows = [df.select(F.lit(part).alias("part"), "id") for part, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@_register
def stored_cascade(spark, sf_dir) -> DataFrame:
    """The cascade on stored tables: both are written, rewritten where rows go, and read back."""
    folder = _fresh_folder(spark, "cascade")
    customers = standins.customers(spark, sf_dir).withColumn("mobile", F.col("id").cast("string"))
    tables.write_requests(customers, f"{folder}/requests")
    tables.write_request_files(standins.request_files(spark, sf_dir), f"{folder}/files")
    tables.delete_requests(spark, f"{folder}/requests", f"{folder}/files", _parents(spark, sf_dir))
    requests, files = (tables.read_table(spark, f"{folder}/{t}") for t in ("requests", "files"))
    return requests.select(F.lit("request").alias("part"), "id", F.col("status").alias("kind")).unionByName(
        files.select(F.lit("file").alias("part"), "id", F.col("file_type").alias("kind"))
    )


@_register
def bucketed_request_files(spark, sf_dir) -> DataFrame:
    """Requests and files joined where they lie: both tables are bucketed on the request id."""
    names_ = [f"{t}_{uuid4().hex}" for t in ("requests", "files")]
    frames = [standins.customers(spark, sf_dir), standins.request_files(spark, sf_dir)]
    for name, df, key in zip(names_, frames, ("id", "request_id"), strict=True):
        tables.write_bucketed(df, name, key, 8, [key], _fresh_folder(spark, "bucketed"))
    return relations.request_with_files(*map(spark.table, names_))


# ---- quality -----------------------------------------------------------------------


@_register
def domain_check(spark, sf_dir) -> DataFrame:
    files = standins.request_files(spark, sf_dir)
    return quality.domain_check(files, "file_type", ("click", "purchase", "view"))


@_register
def unique_check(spark, sf_dir) -> DataFrame:
    return quality.unique_check(
        standins.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    )


@_register
def required_check(spark, sf_dir) -> DataFrame:
    checked = quality.required_check(
        standins.labelled_documents(spark, sf_dir), ["text", "quality", "toxic"]
    )
    return checked.select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@_register
def length_check(spark, sf_dir) -> DataFrame:
    documents = standins.table(spark, sf_dir, "documents")
    return quality.length_check(documents, "doc_id", {"text": 500, "source": 4})


@_register
def type_check(spark, sf_dir) -> DataFrame:
    return quality.type_check(standins.page_names(spark, sf_dir), "page_id", {"name": "int"})


@_register
def quality_profile(spark, sf_dir) -> DataFrame:
    d = standins.labelled_documents(spark, sf_dir)
    columns = ["doc_id", "text", "lang", "source", "quality", "toxic"]
    return quality.quality_profile(d, columns, {"source": 4}, ["doc_id", "text"])


@_register
def storage_reconcile(spark, sf_dir) -> DataFrame:
    found = quality.storage_reconcile(
        standins.stored_documents(spark, sf_dir), standins.catalogued_files(spark, sf_dir)
    )
    none = F.lit(-1).cast("long")
    return found.withColumns(
        {"disk_bytes": F.coalesce("disk_bytes", none), "row_bytes": F.coalesce("row_bytes", none)}
    )


@_register
def reconcile_by_digest(spark, sf_dir) -> DataFrame:
    found = quality.reconcile_by_digest(
        standins.stored_documents(spark, sf_dir), standins.catalogued_files(spark, sf_dir)
    )
    none = F.lit(-1).cast("long")
    return found.withColumns(
        {"disk_bytes": F.coalesce("disk_bytes", none), "row_bytes": F.coalesce("row_bytes", none)}
    )


@_register
def checked_in_one_pass(spark, sf_dir) -> DataFrame:
    """What one pass over the submissions has counted, and what it has written."""
    folder = _fresh_folder(spark, "outcome")
    checked = intake.check_submissions(landing.parse_submissions(standins.rough_submissions(spark, sf_dir), "value"))
    reasons = ("submission_id:required", "contact_name:required", "mobile:required", "line:unreadable")
    counted = quality.write_by_outcome(checked, folder, reasons)
    seen = spark.createDataFrame([(f"seen {k}", v) for k, v in counted.items()], "part string, rows long")
    written = spark.read.parquet(folder).groupBy(F.concat(F.lit("written "), "outcome").alias("part"))
    return seen.unionByName(written.agg(F.count("*").alias("rows")))


@_register
def reconcile_summary(spark, sf_dir) -> DataFrame:
    return quality.reconcile_summary(
        quality.storage_reconcile(
            standins.stored_documents(spark, sf_dir), standins.catalogued_files(spark, sf_dir)
        )
    )


# ---- change ---------------------------------------------------------------------------


@_register
def audit_upsert(spark, sf_dir) -> DataFrame:
    feed = standins.status_feed(spark, sf_dir).select(
        "id", "status", F.struct("ts", "event_id").alias("turn")
    )
    return change.audit_upsert(standins.vehicle_snapshot(spark, sf_dir), feed, NOW, order="turn")


def _early_requests(spark, sf_dir):
    return standins.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


@_register
def evolve_up(spark, sf_dir) -> DataFrame:
    evolved, rejected = change.evolve_up(_early_requests(spark, sf_dir), NOW)
    kept = evolved.select(
        "id",
        "status",
        F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("updated_at").alias("updated_us"),
        F.lit("").alias("reasons"),
    )
    broken = rejected.select(
        "id",
        "status",
        F.unix_micros(utc_instant("created_at")).alias("created_us"),
        F.lit(-1).cast("long").alias("updated_us"),
        F.array_join("reasons", ",").alias("reasons"),
    )
    return kept.unionByName(broken)


@_register
def evolve_down(spark, sf_dir) -> DataFrame:
    evolved, _ = change.evolve_up(_early_requests(spark, sf_dir), NOW)
    return change.evolve_down(evolved)


@_register
def catalogue_evolution(spark, sf_dir) -> DataFrame:
    """The later schema in the catalogue: old rows show its default, new rows their own time."""
    requests, files = (f"{t}_{uuid4().hex}" for t in ("requests", "request_files"))
    early = _early_requests(spark, sf_dir)
    early.write.option("path", _fresh_folder(spark, "evolved")).saveAsTable(requests)
    change.evolve_table_up(spark, requests, files, _fresh_folder(spark, "evolved"), NOW)
    # a nation each as a request of its own time
    nations = standins.table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 5_000_000).cast("long").alias("id"),
        F.col("n_name").alias("status"),
        F.lit("2025-01-01").cast("timestamp_ntz").alias("created_at"),
        F.timestamp_seconds(F.lit(1_800_000_000) + F.col("n_nationkey")).alias("updated_at"),
    )
    nations.write.insertInto(requests)
    at = utc_instant("created_at")
    stored = standins.request_files(spark, sf_dir).withColumns(
        {"created_at": at, "updated_at": at, "content_type": F.lit(None).cast("string")}
    )
    stored.select(*[F.col(f.name).cast(f.dataType) for f in schemas.REQUEST_FILES.fields]).write.insertInto(files)
    rows = [
        spark.table(requests).select(F.lit("request").alias("part"), "id", "status", "updated_at"),
        spark.table(files).select(F.lit("file").alias("part"), "id", F.col("file_type").alias("status"), "updated_at"),
    ]
    return rows[0].unionByName(rows[1]).select("part", "id", "status", F.unix_micros("updated_at").alias("updated_us"))


@_register
def mobile_lookup(spark, sf_dir) -> DataFrame:
    """Requests of one mobile, found through the stored layout."""
    folder = _fresh_folder(spark, "requests")
    tables.write_requests(standins.requests(spark, sf_dir), folder)
    return tables.by_mobile(spark, folder, "7").select("id", "company_name", "mobile", "status", "created_at")


@_register
def layout(spark, sf_dir) -> DataFrame:
    folder = _fresh_folder(spark, "requests")
    tables.write_requests(standins.requests(spark, sf_dir), folder)
    stored = tables.read_table(spark, folder)
    # one pruned read per status
    parts = [_layout_row(stored.filter(F.col("status") == s), "requests", s) for s in ("F", "O", "P")]
    files = _fresh_folder(spark, "files")
    tables.write_request_files(standins.request_files(spark, sf_dir), files)
    stored = tables.read_table(spark, files)
    parts += [
        _layout_row(stored.filter(F.col("file_type") == t), "files", t) for t in standins.EVENT_TYPES
    ]
    name = f"layout_{uuid4().hex}"
    tables.write_bucketed(
        standins.customers(spark, sf_dir), name, "id", 8, ["id"], _fresh_folder(spark, "bucketed")
    )
    parts.append(_layout_row(spark.table(name), "bucketed", ""))
    return reduce(DataFrame.unionByName, parts)


def _layout_row(df: DataFrame, table: str, part: str) -> DataFrame:
    return df.agg(
        F.lit(table).alias("table"),
        F.lit(part).alias("part"),
        F.count("*").alias("rows"),
        F.sum("id").alias("id_sum"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
    )


# ---- reports -----------------------------------------------------------------------------


def _kpis(spark, sf_dir):
    orders = standins.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("company"), F.col("o_orderstatus").alias("status")
    )
    return reports.kpi_counts(
        standins.table(spark, sf_dir, "nation"),
        orders,
        standins.table(spark, sf_dir, "supplier"),
        standins.READY,
    )


@_register
def kpi_counts(spark, sf_dir) -> DataFrame:
    return _kpis(spark, sf_dir)


@_register
def kpi_fallback(spark, sf_dir) -> DataFrame:
    live = _kpis(spark, sf_dir).drop("projects")
    return reports.kpi_fallback(live.withColumn("vehicles", F.lit(None).cast("long")))


@_register
def intake_stats(spark, sf_dir) -> DataFrame:
    return reports.intake_stats(standins.request_files(spark, sf_dir), standins.EVENT_TYPES)


@_register
def company_dim(spark, sf_dir) -> DataFrame:
    # the first hundred suppliers' numbers are customers too, the nations are not
    suppliers = standins.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit("Customer#"), F.substring("s_name", 10, 9)).alias("name"),
        F.col("s_name").alias("code"),
    )
    nations = standins.table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 5_000_000).cast("long").alias("id"),
        F.col("n_name").alias("name"),
        F.lit(None).cast("string").alias("code"),
    )
    at = utc_instant(F.lit("2024-01-01").cast("timestamp_ntz"))
    known = suppliers.unionByName(nations).withColumns({"created_at": at, "updated_at": at})
    return _stamped(reports.company_dim(standins.customers(spark, sf_dir), known, NOW))


@_register
def latest_status(spark, sf_dir) -> DataFrame:
    return reports.latest_status(standins.status_feed(spark, sf_dir))


# ---- allocation -----------------------------------------------------------------------------


def _allocation(spark, sf_dir):
    vehicles = standins.fleet(spark, sf_dir)
    return allocation.allocate_orders(standins.delivery_orders(spark, sf_dir), vehicles), vehicles


@_register
def allocate_orders(spark, sf_dir) -> DataFrame:
    rows, _ = _allocation(spark, sf_dir)
    return rows.withColumn("vehicle_id", F.coalesce("vehicle_id", F.lit(-1).cast("long")))


@_register
def manual_review(spark, sf_dir) -> DataFrame:
    return allocation.manual_review(_allocation(spark, sf_dir)[0])


@_register
def unassigned_orders(spark, sf_dir) -> DataFrame:
    orders = standins.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("order_ts")
    )
    recorded = standins.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id")
    )
    return allocation.unassigned(orders, recorded)


@_register
def vehicle_load(spark, sf_dir) -> DataFrame:
    return allocation.vehicle_load(*_allocation(spark, sf_dir))


@_register
def run_summary(spark, sf_dir) -> DataFrame:
    return allocation.run_summary(*_allocation(spark, sf_dir))


@_register
def run_summary_by_zone(spark, sf_dir) -> DataFrame:
    by_zone = allocation.run_summary_by_zone(*_allocation(spark, sf_dir))
    return by_zone.withColumn("zone", F.coalesce("zone", F.lit(-1)))


@_register
def run_log(spark, sf_dir) -> DataFrame:
    orders, vehicles = standins.delivery_orders(spark, sf_dir), standins.fleet(spark, sf_dir)
    summary = allocation.run_summary(allocation.allocate_orders(orders, vehicles), vehicles)
    digest = allocation.input_digest(orders, vehicles)
    folder = _fresh_folder(spark, "run_log")
    log = pin(allocation.run_log(summary, digest, "queue=order_ts", NOW))
    for _ in range(2):  # a repeated run replaces its entry
        tables.append_run(log, folder)
    stored = tables.read_table(spark, folder)
    return stored.withColumn("run_at", F.unix_micros("run_at")).withColumnRenamed("run_at", "run_us")


# ---- streams --------------------------------------------------------------------------------


def _stream(spark, sf_dir, name):
    # a pattern, because a stream takes no path that is one plain file
    schema = standins.table(spark, sf_dir, name).schema
    return feeds.file_feed(spark, f"{sf_dir}/{name}*.parquet", schema)


@_register
def latest_status_stream(spark, sf_dir) -> DataFrame:
    folder = _fresh_folder(spark, "latest_status")
    feed = standins.as_status_feed(_stream(spark, sf_dir, "events"))
    feeds.start_latest_status(feed, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return feeds.read_latest_status(spark, f"{folder}/log")


@_register
def submission_stream(spark, sf_dir) -> DataFrame:
    folder = _fresh_folder(spark, "submissions")
    landed = _stream(spark, sf_dir, "documents")
    labelled = landed.join(standins.table(spark, sf_dir, "labels"), "doc_id", "left")
    feeds.start_submissions(
        landing.parse_submissions(standins.as_submissions(labelled), "value"),
        lambda: NOW,
        f"{folder}/tables",
        f"{folder}/checkpoint",
        run=RUN,
    ).awaitTermination()
    made = [feeds.read_submissions(spark, f"{folder}/tables", t) for t in feeds.SUBMISSION_TABLES]
    return _outcome(*made)


@_register
def resubmission_stream(spark, sf_dir) -> DataFrame:
    """Submissions that land three times, batch by batch, the stream started anew for each.

    First those of documents labelled low lack a mobile. Then these come corrected, toxic ones again as
    they were, and good ones without their empty industry. Then the first low ones once more.
    """
    folder = _fresh_folder(spark, "resubmissions")
    texts = standins.as_submissions(standins.labelled_documents(spark, sf_dir), "quality", "toxic")

    def without(df, name):
        return df.withColumn("value", F.regexp_replace("value", f'"{name}":"[^"]*",', ""))

    low, other = texts.filter("quality = 0"), texts.filter("quality IS NULL OR quality = 1")
    again = texts.filter("quality = 1 AND toxic = 1").unionByName(
        without(texts.filter("quality = 1 AND toxic = 0"), "industry")
    )
    broken = without(low, "mobile")
    for part in (broken.unionByName(other), low.unionByName(again), broken):
        part.select("value").write.mode("append").parquet(f"{folder}/in")
        feed = feeds.file_feed(spark, f"{folder}/in", T.StructType([T.StructField("value", T.StringType())]))
        feeds.start_submissions(
            landing.parse_submissions(feed, "value"),
            lambda: NOW,
            f"{folder}/tables",
            f"{folder}/checkpoint",
            run=RUN,
        ).awaitTermination()
    made = [feeds.read_submissions(spark, f"{folder}/tables", t) for t in feeds.SUBMISSION_TABLES]
    return _outcome(*made)


@_register
def waiting_files_stream(spark, sf_dir) -> DataFrame:
    """events as files that may land before their request: a supplier's, one each day of the month."""
    folder = _fresh_folder(spark, "waiting")
    first = F.lit("2024-01-01").cast("timestamp_ntz")
    files = standins.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("request_id"),
        F.col("event_type").alias("file_type"),
        utc_instant("ts").alias(feeds.ARRIVED),
    )
    requests = _parents(spark, sf_dir).withColumn(
        feeds.ARRIVED, utc_instant(F.timestamp_add("DAY", (F.col("id") % 28).cast("int"), first))
    )
    late = utc_instant(F.timestamp_add("DAY", F.lit(10), first)), utc_instant(F.timestamp_add("DAY", F.lit(20), first))
    part = F.when(F.col(feeds.ARRIVED) < late[0], 0).when(F.col(feeds.ARRIVED) < late[1], 1).otherwise(2)
    # ten days land, and the stream is started; then the next ten
    for n in range(3):
        streams = []
        for name, df in (("files", files), ("requests", requests)):
            df.filter(part == n).write.mode("append").parquet(f"{folder}/{name}")
            streams.append(feeds.file_feed(spark, f"{folder}/{name}", df.schema))
        feeds.start_waiting_files(
            *streams, timedelta(days=3), f"{folder}/taken", f"{folder}/checkpoint"
        ).awaitTermination()
    return feeds.read_intake(spark, f"{folder}/taken").select("id", "request_id", "file_type", "known")


@_register
def manifest_stream(spark, sf_dir) -> DataFrame:
    """Suppliers as files that land in three parts, taken in as a stream, each file once."""
    folder = _fresh_folder(spark, "manifest")
    root = f"{folder}/disk".removeprefix("file:")
    files = standins.supplier_files(spark, sf_dir)
    for n in range(3):
        pin(landing.write_files(files.filter(F.pmod(F.xxhash64("path"), F.lit(3)) == n), root))
        feed = feeds.manifest_feed(spark, f"{root}/uploads")
        feeds.start_manifest(feed, f"{folder}/manifest", f"{folder}/checkpoint").awaitTermination()
    manifest = tables.read_table(spark, f"{folder}/manifest").drop("batch", "modified_at")
    return manifest.withColumn("path", names.relative_path("path"))


@_register
def intake_stream(spark, sf_dir) -> DataFrame:
    folder = _fresh_folder(spark, "intake")
    events = standins.table(spark, sf_dir, "events")
    # the whole table in four parts, one of them twice, and some files per batch
    for part in (0, 1, 2, 3, 1):
        events.filter(F.pmod(F.hash("event_id"), F.lit(4)) == part).repartition(2).write.mode(
            "append"
        ).parquet(f"{folder}/in")
    rows = feeds.file_feed(spark, f"{folder}/in", events.schema, files_per_batch=2).select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("request_id"),
        F.col("event_type").alias("file_type"),
    )
    feeds.start_intake(
        rows, lambda: _parents(spark, sf_dir), f"{folder}/files", f"{folder}/checkpoint"
    ).awaitTermination()
    return feeds.read_intake(spark, f"{folder}/files")


@_register
def kpi_stream(spark, sf_dir) -> DataFrame:
    folder = _fresh_folder(spark, "kpis")
    orders = _stream(spark, sf_dir, "orders")
    feeds.start_kpis(
        orders,
        standins.READY,
        f"{folder}/log",
        f"{folder}/checkpoint",
        company="o_custkey",
        status="o_orderstatus",
    ).awaitTermination()
    projects, vehicles = (standins.table(spark, sf_dir, t) for t in ("nation", "supplier"))
    return feeds.read_kpis(spark, f"{folder}/log", projects, vehicles)
