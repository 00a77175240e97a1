"""Landed form submissions and uploads to request and file rows.

Batch and stream share these functions: each is a DataFrame to DataFrame step.
``now`` is passed in, so a repeated run gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave import fixed_values as fv
from loadweave import schemas
from loadweave.functions import names
from loadweave.functions.ordered import dense_ids
from loadweave.functions.times import stamp
from loadweave.operators.quality import REASONS, fails_cast, rule_reasons, split_valid
from loadweave.operators.relations import file_pages
from loadweave.session import pin

_FORM_TEXT = (
    "submission_id",
    "company_name",
    "contact_name",
    "mobile",
    "email",
    "industry",
    "goal",
)
LANDED_ROW = "landed_row"


def with_defaults(df: DataFrame) -> DataFrame:
    """Empty text for optional fields left out, the first status, size 0."""
    empty = {c: names.or_empty(c) for c in ("email", "industry", "goal") if c in df.columns}
    fixed = {}
    if "status" in df.columns:
        fixed["status"] = names.with_default("status", fv.DEFAULT_STATUS)
    if "file_size" in df.columns:
        fixed["file_size"] = names.with_default("file_size", F.lit(0).cast("long"))
    return df.withColumns({**empty, **fixed})


def numbered(landed: DataFrame) -> DataFrame:
    """Landed rows with a number each. It holds from the moment the rows are written down."""
    return landed.withColumn(LANDED_ROW, F.monotonically_increasing_id())


def check_submissions(submissions: DataFrame) -> DataFrame:
    """Submissions with the reasons against them, empty where there are none."""
    reasons = rule_reasons(schemas.SUBMISSION, _FORM_TEXT)
    if schemas.RAW_TEXT in submissions.columns:
        broken = F.when(F.col(schemas.RAW_TEXT).isNotNull(), F.array(F.lit("line:unreadable")))
        reasons = F.concat(F.coalesce(broken, F.array().cast("array<string>")), reasons)
    return submissions.withColumn(REASONS, reasons)


def content_hash(columns: Sequence[str]) -> Column:
    """A hash of the values and of which of them are NULL: ``xxhash64`` passes over those."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def has_key() -> Column:
    """Rows without a submission id are never copies of each other: nothing tells which are."""
    return F.coalesce(F.col("submission_id") != "", F.lit(False))


def one_of_each(checked: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """One checked row per submission, where some landed more than once.

    Of unequal copies one that passes the checks is taken, if any does, and of several the
    one with the smallest hash of its content, so the choice does not depend on where rows
    lie. It is made on narrow columns and written down; texts then meet the chosen row
    numbers, which no two rows share. Rows without id all stay.

    ``fresh`` holds the submissions that no earlier batch has taken. A copy that passes, of
    one that was taken before, has the reason ``submission_id:unequal_copy``.
    """
    content = content_hash([c for c in checked.columns if c not in (LANDED_ROW, REASONS)])
    narrow = checked.select(
        "submission_id", LANDED_ROW, F.struct(F.size(REASONS) > 0, content.alias("hash")).alias("turn")
    )
    # rows equal in the hash are equal: which of them is taken shows nowhere
    chosen = (
        narrow.filter(has_key())
        .groupBy("submission_id")
        .agg(F.min_by(LANDED_ROW, "turn").alias(LANDED_ROW))
    )
    late = F.lit(False)
    if fresh is not None:
        chosen = chosen.join(fresh.select("submission_id", F.lit(True).alias("fresh")), "submission_id", "left")
        late = F.col("fresh").isNull()
    chosen = chosen.select(LANDED_ROW, late.alias("late"))
    alone = narrow.filter(~has_key()).select(LANDED_ROW, F.lit(False).alias("late"))
    kept = pin(chosen.unionByName(alone))
    unequal = F.when(F.col("late") & (F.size(REASONS) == 0), F.array(F.lit("submission_id:unequal_copy")))
    return checked.join(kept, LANDED_ROW).withColumn(REASONS, F.coalesce(unequal, REASONS)).drop("late")


def request_rows(valid: DataFrame, now: datetime, start_id: int = 1) -> DataFrame:
    """Request rows for valid submissions of unique id, still carrying their slots.

    Ids are dealt out on the keys alone and then joined to the rows on the landed row,
    by which choosing one of each has brought the wide rows together already.
    """
    keys = valid.select("submission_id", LANDED_ROW)
    ids = dense_ids(keys, ["submission_id"], "id", start_id).select("id", LANDED_ROW)
    at = stamp(now)
    return with_defaults(
        valid.join(ids, LANDED_ROW).withColumns(
            {"status": F.lit(fv.DEFAULT_STATUS), "created_at": at, "updated_at": at}
        )
    )


def _slot(file: Column, file_type: str) -> Column:
    return F.struct(F.lit(file_type).alias("file_type"), file.alias("file"))


def slot_unpivot(submissions: DataFrame, *keep: str) -> DataFrame:
    """One row per slot entry: kept columns, position, file_type, file.

    The single slots come first, in form order, then the list slot flattened.
    """
    list_name, list_type = fv.LIST_SLOT
    singles = F.array(*[_slot(F.col(slot), kind) for slot, kind in fv.SINGLE_SLOTS])
    listed = F.transform(
        F.coalesce(F.col(list_name), F.array().cast(schemas.SUBMISSION[list_name].dataType)),
        lambda f: _slot(f, list_type),
    )
    return submissions.select(
        *keep, F.posexplode(F.concat(singles, listed)).alias("position", "slot")
    ).select(*keep, "position", "slot.*")


def slot_filter(slots: DataFrame) -> DataFrame:
    """Entries with a file and a file name; a file without content stays."""
    return slots.filter(F.col("file").isNotNull() & (names.or_empty("file.filename") != ""))


def form_file_rows(
    requests: DataFrame, now: datetime, start_id: int = 1, run: str = ""
) -> DataFrame:
    """File rows of the form layout for request rows that carry slots.

    A client name with a path separator is reduced to its last part. The stored
    name derives from the run and the file's place, so a retry repeats it.
    """
    slots = slot_filter(slot_unpivot(requests.withColumnRenamed("id", "request_id"), "request_id"))
    named = slots.select(
        "request_id",
        "position",
        "file_type",
        names.base_name("file.filename").alias("original_name"),
        F.col("file.content_type").alias("content_type"),
        F.col("file.size").alias("file_size"),
    )
    seed = F.concat_ws("|", F.lit(run), "request_id", "position", "original_name")
    pathed = named.withColumns(
        {
            "stored_name": names.stored_name_form("original_name", seed),
            "file_path": names.landing_path_form("request_id", "file_type", "original_name"),
        }
    )
    return _as_file_rows(dense_ids(pathed, ["request_id", "position"], "id", start_id), now)


def upload_file_rows(uploads: DataFrame, now: datetime, start_id: int = 1) -> DataFrame:
    """File rows of the upload layout, next to their ``upload_id``.

    ``uploads`` has upload_id, request_id, position, file_type, filename, content_type,
    size; (upload_id, position) is unique. The upload's id is part of what the stored name derives
    from, so a name uploaded again does not overwrite the first, and a retry repeats it.
    """
    named = uploads.select(
        "upload_id",
        "request_id",
        "position",
        "file_type",
        names.base_name("filename").alias("original_name"),
        "content_type",
        F.col("size").alias("file_size"),
    )
    seed = F.to_json(F.array(*[F.col(c).cast("string") for c in ("upload_id", "position", "original_name")]))
    stored = named.withColumn("stored_name", names.stored_name_upload("original_name", seed))
    pathed = stored.withColumn("file_path", names.landing_path_upload("request_id", "stored_name"))
    return _as_file_rows(
        dense_ids(pathed, ["upload_id", "position"], "id", start_id), now, "upload_id"
    )


def _as_file_rows(with_ids: DataFrame, now: datetime, *keep: str) -> DataFrame:
    at = stamp(now)
    stamped = with_defaults(with_ids).withColumns({"created_at": at, "updated_at": at})
    return stamped.select(
        *keep, *[F.col(f.name).cast(f.dataType) for f in schemas.REQUEST_FILES.fields]
    )


def upload_intake(
    uploads: DataFrame, requests: DataFrame, now: datetime, start_id: int = 1
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, files of unknown requests, rejected files, receipts) of a set of uploads.

    Files are checked first, then split by whether their request exists. A receipt lists
    what one upload call has stored; a call beyond a page has several.
    """
    checked = pin(check_files(upload_file_rows(uploads, now, start_id)))
    good, rejected = split_valid(checked)
    known = requests.select(F.col("id").alias("request_id")).distinct()
    orphans = good.join(known, "request_id", "left_anti")
    stored = good.join(known, "request_id", "left_semi")
    return stored, orphans, rejected, upload_receipt(stored, by="upload_id")


def intake(
    submissions: DataFrame,
    now: datetime,
    start_request_id: int = 1,
    start_file_id: int = 1,
    run: str = "",
    fresh: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(requests, files, rejected submissions, rejected files) of one set of landed rows.

    Every landed row is a request, a reject or a copy of one of these. Rejects come one by
    one, with reasons and, where a line could not be read, its text. Rows are read several
    times: those that carry no ``landed_row`` yet are numbered and written down first.
    ``fresh`` is for ``one_of_each``.
    """
    landed = submissions if LANDED_ROW in submissions.columns else pin(numbered(submissions))
    valid, rejected = split_valid(one_of_each(check_submissions(landed), fresh))
    carried = request_rows(valid, now, start_request_id)
    requests = carried.select(*[F.col(f.name).cast(f.dataType) for f in schemas.REQUESTS.fields])
    checked = check_files(form_file_rows(carried, now, start_file_id, run))
    files, bad_files = split_valid(checked)
    return requests, files, rejected, bad_files


def check_files(files: DataFrame) -> DataFrame:
    """File rows with the reasons against them; derived names are checked too."""
    return files.withColumn(REASONS, rule_reasons(schemas.REQUEST_FILES))


def upload_receipt(
    files: DataFrame, page_size: int = 1000, by: str = "request_id"
) -> DataFrame:
    """``by``, page, success, files: what an upload reports back, in bounded pages."""
    pages = file_pages(files, page_size, "original_name", "stored_name", "file_type", by=by)
    return pages.select(by, "page", F.lit(True).alias("success"), "files")


def receipt_json(receipts: DataFrame) -> DataFrame:
    """Receipts with the answer as one JSON text."""
    keys = [c for c in receipts.columns if c not in ("success", "files")]
    return receipts.select(*keys, F.to_json(F.struct("success", "files")).alias("receipt"))


def project_intake(projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid projects with a numeric fleet size, rejected ones with reasons)."""
    reasons = rule_reasons(schemas.PROJECT_FORM, casts={"fleet_size": "int"})
    valid, rejected = split_valid(projects.withColumn(REASONS, reasons))
    typed = valid.withColumns(
        {
            "fleet_size": F.when(~fails_cast("fleet_size", "int"), F.col("fleet_size").try_cast("int")),
            "description": names.or_empty("description"),
        }
    )
    return typed, rejected
