"""Expressions for uploaded file names, paths, sizes and defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadweave import fixed_values as fv


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def base_name(path: Column | str) -> Column:
    """What follows the last ``/`` or ``\\``."""
    return F.regexp_extract(_col(path), r"([^/\\]*)$", 1)


def file_suffix(name: Column | str) -> Column:
    """Last dot onward; empty for dot-files, names without a dot and a trailing dot."""
    return F.regexp_extract(_col(name), r"^.+(\.[^.]+)$", 1)


def size_bytes(content: Column | str) -> Column:
    """Length in bytes, not in characters."""
    return F.octet_length(_col(content)).cast("long")


def or_empty(value: Column | str) -> Column:
    return F.coalesce(_col(value), F.lit(""))


def with_default(value: Column | str, default) -> Column:
    return F.coalesce(_col(value), F.lit(default))


def status_class(status: Column | str) -> Column:
    return F.concat(F.lit(fv.STATUS_CLASS_PREFIX), F.lower(_col(status)))


def _uuid_like(seed: Column) -> Column:
    """36-character identifier that depends on ``seed`` alone, so a retry repeats it."""
    digest = F.sha2(seed, 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, at, size) for at, size in cuts])


def stored_name_form(name: Column | str, seed: Column | None = None) -> Column:
    """Identifier, underscore, client name.

    Without ``seed`` the identifier is random: pin such rows before using them
    twice.
    """
    ident = F.uuid() if seed is None else _uuid_like(seed)
    return F.concat_ws("_", ident, _col(name))


def stored_name_upload(name: Column | str, seed: Column | None = None) -> Column:
    """Identifier as 32 hex digits, then the suffix of the client name."""
    ident = F.uuid() if seed is None else _uuid_like(seed)
    return F.concat(F.regexp_replace(ident, "-", ""), file_suffix(name))


def landing_path_form(request_id, file_type, name, base: str = fv.UPLOAD_FOLDER) -> Column:
    """``<base>/<id>/<id>_<type>_<name>``"""
    request_id = _col(request_id).cast("string")
    leaf = F.concat_ws("_", request_id, _col(file_type), _col(name))
    return F.concat_ws("/", F.lit(base), request_id, leaf)


def landing_path_upload(request_id, stored_name, base: str = fv.UPLOAD_FOLDER) -> Column:
    """``<base>/<id>/<stored name>``"""
    return F.concat_ws("/", F.lit(base), _col(request_id).cast("string"), _col(stored_name))


def relative_path(path: Column | str, base: str = fv.UPLOAD_FOLDER) -> Column:
    """Path from the upload folder on, without scheme, host or mount point.

    A path that is not ``<base>/<id>/<leaf>`` stays as it is.
    """
    inner = F.regexp_extract(_col(path), rf"(?s)(?:^|/)({base}/[0-9]+/[^/]*)$", 1)
    return F.coalesce(F.nullif(inner, F.lit("")), _col(path))


def is_landing_path(path: Column | str, base: str = fv.UPLOAD_FOLDER) -> Column:
    """Whether a path is ``<base>/<id>/<leaf>``, behind any mount point."""
    return F.coalesce(_col(path).rlike(rf"(?s)(?:^|/){base}/[0-9]+/[^/]*$"), F.lit(False))


# <base>/<id>/<leaf>; the form layout repeats the id in the leaf and names a type
_FOLDER = rf"(?s)(?:^|/){fv.UPLOAD_FOLDER}/([0-9]+)/[^/]*$"
_FORM_LEAF = r"(?s)^([0-9]+)_(" + "|".join(fv.FILE_TYPES) + r")_(.+)$"
_UPLOAD_LEAF = r"^[0-9a-f]{32}(\.[^.]+)?$"


def parsed_path(path: Column | str) -> Column:
    """Struct of request_id, layout, file_type, original_name read off a landed path.

    The upload layout keeps neither type nor client name, so both stay NULL.
    """
    path = _col(path)
    folder = F.regexp_extract(path, _FOLDER, 1)
    leaf = base_name(path)
    in_form = (F.regexp_extract(leaf, _FORM_LEAF, 1) == folder) & (folder != "")
    in_upload = (folder != "") & leaf.rlike(_UPLOAD_LEAF)
    return F.struct(
        folder.try_cast("long").alias("request_id"),
        F.when(in_form, F.lit("form"))
        .when(in_upload, F.lit("upload"))
        .otherwise(F.lit("unknown"))
        .alias("layout"),
        F.when(in_form, F.regexp_extract(leaf, _FORM_LEAF, 2)).alias("file_type"),
        F.when(in_form, F.regexp_extract(leaf, _FORM_LEAF, 3)).alias("original_name"),
    )
