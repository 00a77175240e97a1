"""Declared table schemas.

Text limits, uniqueness and references travel as column metadata, so the
quality operators are generated from the schema instead of being written per
table.
"""

from __future__ import annotations

from pyspark.sql import types as T

from loadweave import fixed_values as fv


def _text(name, limits, *, required=False, **extra):
    meta = dict(extra)
    if name in limits:
        meta["max_chars"] = limits[name]
    if required:
        meta["required"] = True
    return T.StructField(name, T.StringType(), True, meta)


def _key(name="id", **extra):
    return T.StructField(name, T.LongType(), True, {"required": True, **extra})


def _times():
    return [
        T.StructField("created_at", T.TimestampType(), True, {"required": True}),
        T.StructField("updated_at", T.TimestampType(), True, {"required": True}),
    ]


REQUESTS = T.StructType(
    [
        _key(unique=True),
        _text("company_name", fv.REQUEST_LIMITS, required=True),
        _text("contact_name", fv.REQUEST_LIMITS, required=True),
        _text("mobile", fv.REQUEST_LIMITS, required=True),
        _text("email", fv.REQUEST_LIMITS),
        _text("industry", fv.REQUEST_LIMITS),
        _text("goal", fv.REQUEST_LIMITS),
        _text("status", fv.REQUEST_LIMITS, required=True),
        *_times(),
    ]
)

REQUEST_FILES = T.StructType(
    [
        _key(unique=True),
        _key("request_id", references="requests.id"),
        _text("file_type", fv.FILE_LIMITS, required=True, domain=list(fv.FILE_TYPES)),
        _text("original_name", fv.FILE_LIMITS, required=True),
        _text("stored_name", fv.FILE_LIMITS, required=True, unique=True),
        _text("file_path", fv.FILE_LIMITS, required=True),
        _text("content_type", fv.FILE_LIMITS),
        T.StructField("file_size", T.LongType(), True, {"required": True}),
        *_times(),
    ]
)

COMPANIES = T.StructType(
    [
        _key(unique=True),
        _text("name", fv.COMPANY_LIMITS, required=True),
        _text("code", fv.COMPANY_LIMITS, unique=True),
        *_times(),
    ]
)

# One uploaded file as a form slot holds it.
SLOT_FILE = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("size", T.LongType()),
    ]
)

# One landed form submission. submission_id is the natural key of the landing row.
SUBMISSION = T.StructType(
    [
        _text("submission_id", {}, required=True),
        _text("company_name", fv.REQUEST_LIMITS, required=True),
        _text("contact_name", fv.REQUEST_LIMITS, required=True),
        _text("mobile", fv.REQUEST_LIMITS, required=True),
        _text("email", fv.REQUEST_LIMITS),
        _text("industry", fv.REQUEST_LIMITS),
        _text("goal", fv.REQUEST_LIMITS),
        *[T.StructField(slot, SLOT_FILE) for slot, _ in fv.SINGLE_SLOTS],
        T.StructField(fv.LIST_SLOT[0], T.ArrayType(SLOT_FILE)),
    ]
)

# As it lands: RAW_TEXT holds a line that is no readable submission.
RAW_TEXT = "raw_text"
LANDED = T.StructType([*SUBMISSION.fields, T.StructField(RAW_TEXT, T.StringType())])

# The project form. fleet_size lands as text and is typed by the intake.
PROJECT_FORM = T.StructType(
    [
        T.StructField("name", T.StringType(), True, {"required": True}),
        T.StructField("company", T.StringType(), True, {"required": True}),
        T.StructField(
            "scenario",
            T.StringType(),
            True,
            {"required": True, "domain": list(fv.SCENARIOS)},
        ),
        T.StructField("fleet_size", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)


def fields_with(schema: T.StructType, key: str) -> dict:
    """Column name to metadata value, for the columns that declare ``key``."""
    return {f.name: f.metadata[key] for f in schema.fields if key in f.metadata}


def required_columns(schema: T.StructType) -> list[str]:
    return list(fields_with(schema, "required"))
