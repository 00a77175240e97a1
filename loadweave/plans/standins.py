"""The declared tables, read off the driver's test tables.

Each function maps whole tables to one declared table, with filters on values
where the declared meaning asks for them and never on ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave import fixed_values as fv
from loadweave.functions import names

# event_type values of the test data, in the place of the five file types
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

READY = "O"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark, sf_dir) -> DataFrame:
    """orders with the customer's name as company."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"),
        F.col("c_name").alias("company_name"),
        F.col("o_orderpriority").alias("contact_name"),
        F.col("o_custkey").cast("string").alias("mobile"),
        F.col("c_mktsegment").alias("industry"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


def customers(spark, sf_dir) -> DataFrame:
    """customer as requests, one each."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("company_name"),
        F.col("c_mktsegment").alias("status"),
    )


def request_files(spark, sf_dir) -> DataFrame:
    """events as request files: the user is the request, the event type the file type."""
    named = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("request_id"),
        F.col("event_type").alias("file_type"),
        F.concat("event_type", F.lit(".json")).alias("original_name"),
        names.size_bytes("props").alias("file_size"),
        F.col("ts").alias("created_at"),
    )
    return named.withColumns(
        {
            "stored_name": F.concat_ws("_", "id", "original_name"),
            "file_path": names.landing_path_form("request_id", "file_type", "original_name"),
        }
    )


def delivery_orders(spark, sf_dir) -> DataFrame:
    """Orders with zone and load; an order without lines has load 0.

    The lines are summed per order before they meet the orders, and the zone
    comes from the customer.
    """
    loads = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("order_id"))
        .agg(F.sum(F.col("l_quantity").cast("long")).alias("load"))
    )
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    zoned = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("order_id"),
        F.col("c_nationkey").alias("zone"),
        F.col("o_orderdate").alias("order_ts"),
    )
    return zoned.join(loads, "order_id", "left").select(
        "zone", "order_id", "order_ts", F.coalesce("load", F.lit(0).cast("long")).alias("load")
    )


def fleet(spark, sf_dir) -> DataFrame:
    """Suppliers as vehicles; capacity is synthetic."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("zone"),
        F.col("s_suppkey").alias("vehicle_id"),
        (F.lit(12000) + F.lit(1000) * (F.col("s_suppkey") % 5)).cast("long").alias("capacity"),
    )


def labelled_documents(spark, sf_dir) -> DataFrame:
    """documents with their label, NULL where there is none."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left")


def submissions(spark, sf_dir) -> DataFrame:
    """One form submission per document, as JSON text in column ``value``."""
    return as_submissions(labelled_documents(spark, sf_dir))


def as_submissions(d: DataFrame, *keep: str) -> DataFrame:
    """Labelled documents as submissions, next to the kept columns.

    Documents without a label lack a contact. Text and slots follow the label, so
    that empty, missing and repeated file names all occur.
    """
    size = names.size_bytes("text")

    def file(name, wanted):
        made = F.struct(
            name.alias("filename"), F.lit("text/csv").alias("content_type"), size.alias("size")
        )
        return F.when(wanted, made)

    leaf = F.concat("lang", F.lit(".csv"))
    twice = file(leaf, F.lit(True))
    return d.select(
        *keep,
        F.to_json(
            F.struct(
                F.lpad(F.col("doc_id").cast("string"), 15, "0").alias("submission_id"),
                F.col("source").alias("company_name"),
                F.when(F.col("quality").isNotNull(), F.col("lang")).alias("contact_name"),
                F.concat(F.lit("0"), F.col("doc_id").cast("string")).alias("mobile"),
                F.when(F.col("toxic") == 1, F.lit("a@b.example")).alias("email"),
                F.when(F.col("toxic") == 0, F.lit("")).alias("industry"),
                F.col("text").alias("goal"),
                file(leaf, F.col("quality") == 1).alias("orders_file"),
                file(F.lit(""), F.col("quality") == 0).alias("fleet_file"),
                file(F.concat(F.lit("in/"), leaf), F.col("toxic") == 1).alias("drivers_file"),
                file(leaf, F.col("n_chars") > 500).alias("gps_file"),
                F.when(F.col("toxic") == 1, F.array(twice, twice)).alias("other_files"),
            )
        ).alias("value"),
    )


def rough_submissions(spark, sf_dir) -> DataFrame:
    """The submissions as a landing really looks: copies, unequal copies, broken lines, no ids.

    Documents labelled low land twice; toxic ones land again without an id, and again without a
    mobile; good ones land again without their empty industry; those in German are
    followed by half a line.
    """
    d = labelled_documents(spark, sf_dir)
    texts = as_submissions(d, "quality", "toxic", "lang")
    low = texts.filter("quality = 0")
    toxic = texts.filter("toxic = 1")

    def without(df, *fields):
        kept = F.col("value")
        for name in fields:
            kept = F.regexp_replace(kept, f'"{name}":"[^"]*",', "")
        return df.withColumn("value", kept)

    half = texts.filter("lang = 'de'").withColumn("value", F.substring("value", 1, 30))
    good = without(texts.filter("toxic = 0"), "industry")
    parts = [texts, low, without(toxic, "submission_id"), without(toxic, "mobile"), good, half]
    return reduce(DataFrame.unionByName, parts).select("value")


def uploads(spark, sf_dir) -> DataFrame:
    """events as uploads: a call per user and day; views have a type that does not exist."""
    kinds = F.create_map(
        *[F.lit(x) for pair in zip(EVENT_TYPES, (*fv.FILE_TYPES[:4], "view"), strict=True) for x in pair]
    )
    return table(spark, sf_dir, "events").select(
        F.concat_ws("-", F.col("user_id"), F.date_format("ts", "yyyyMMdd")).alias("upload_id"),
        F.col("user_id").alias("request_id"),
        F.col("event_id").alias("position"),
        kinds[F.col("event_type")].alias("file_type"),
        F.lit("same.json").alias("filename"),
        F.lit("application/json").alias("content_type"),
        names.size_bytes("props").alias("size"),
    )


def supplier_files(spark, sf_dir) -> DataFrame:
    """Suppliers as small files, empty where the balance is negative: path and content."""
    leaf = F.concat(F.lit("s "), "s_name", F.lit(".txt"))
    return table(spark, sf_dir, "supplier").select(
        names.landing_path_form("s_suppkey", F.lit("fleet"), leaf).alias("path"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("content"),
    )


def landed_documents(spark, sf_dir) -> DataFrame:
    """documents as files on disk: path and size; the layout follows the language."""
    kind = F.element_at(
        F.array(*[F.lit(t) for t in fv.FILE_TYPES]),
        (F.col("doc_id") % 5 + 1).cast("int"),
    )
    leaf = F.concat("lang", F.lit(" 1%.txt"))
    form = names.landing_path_form("doc_id", kind, leaf)
    upload = names.landing_path_upload("doc_id", F.concat(F.md5("text"), F.lit(".txt")))
    loose = names.landing_path_upload("doc_id", F.lit("notes.txt"))
    path = (
        F.when(F.col("lang").isin("en", "de"), form)
        .when(F.col("lang") == "fr", upload)
        .otherwise(loose)
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("file:/mnt/"), path).alias("path"), names.size_bytes("text").alias("size")
    )


def catalogued_files(spark, sf_dir) -> DataFrame:
    """File rows for labelled documents, counted in characters, and for pages, not on disk."""
    labelled = (
        table(spark, sf_dir, "labels")
        .join(table(spark, sf_dir, "documents"), "doc_id")
        .select(
            F.col("doc_id").alias("id"),
            names.landing_path_form("doc_id", F.lit("other"), F.concat("lang", F.lit(".txt"))).alias(
                "file_path"
            ),
            F.col("n_chars").alias("file_size"),
        )
    )
    # short pages have paths outside the scheme, each its own
    at = names.landing_path_form("page_id", F.lit("gps"), F.lit("page.html"))
    short = F.concat_ws("/", F.lit("archive"), "page_id", F.lit("page.html"))
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"),
        F.when(F.octet_length("html") < 1000, short).otherwise(at).alias("file_path"),
        names.size_bytes("html").alias("file_size"),
    )
    return labelled.unionByName(pages)


def stored_documents(spark, sf_dir) -> DataFrame:
    """documents as files of the form layout under a mount point: path and size."""
    leaf = F.concat("lang", F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(
        F.concat(
            F.lit("file:/mnt/"), names.landing_path_form("doc_id", F.lit("other"), leaf)
        ).alias("path"),
        names.size_bytes("text").alias("size"),
    )


def page_names(spark, sf_dir) -> DataFrame:
    """page_id and the last path part of the page's address."""
    return table(spark, sf_dir, "pages").select(
        "page_id", names.base_name(F.regexp_replace("url", r"[?#].*$", "")).alias("name")
    )


def status_feed(spark, sf_dir) -> DataFrame:
    """events as status messages of their user."""
    return as_status_feed(table(spark, sf_dir, "events"))


def as_status_feed(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("id"), F.col("event_type").alias("status"), "ts", "event_id"
    )


def vehicle_snapshot(spark, sf_dir) -> DataFrame:
    """supplier as audited rows; created and updated when it first shipped."""
    first = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("id"))
        .agg(F.min("l_shipdate").alias("created_at"))
    )
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.when(F.col("s_acctbal") < 5000, "view").otherwise("click").alias("status"),
    )
    return s.join(first, "id").withColumn("updated_at", F.col("created_at"))


def projects(spark, sf_dir) -> DataFrame:
    """documents as project forms: the scenario follows the language, the fleet the label."""
    scenario = (
        F.when(F.col("lang") == "en", fv.SCENARIOS[0])
        .when(F.col("lang") == "de", fv.SCENARIOS[1])
        .when(F.col("lang") == "fr", fv.SCENARIOS[2])
        .otherwise(F.col("lang"))
    )
    fleet_size = F.when(F.col("toxic") == 1, F.lit("many")).otherwise(
        F.col("quality").cast("string")
    )
    return labelled_documents(spark, sf_dir).select(
        F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("name"),
        F.col("source").alias("company"),
        scenario.alias("scenario"),
        fleet_size.alias("fleet_size"),
        F.col("text").alias("description"),
    )
