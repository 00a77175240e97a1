"""Naive and zoned timestamps, read as UTC whatever the session's zone is.

A plain cast would use the session's zone and shift or merge values around
daylight saving changes.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def utc_instant(naive: Column | str) -> Column:
    """TIMESTAMP of a TIMESTAMP_NTZ that was written in UTC."""
    naive = F.col(naive) if isinstance(naive, str) else naive
    return F.make_timestamp_ltz(
        F.year(naive),
        F.month(naive),
        F.day(naive),
        F.hour(naive),
        F.minute(naive),
        F.extract(F.lit("SECOND"), naive),
        F.lit("UTC"),
    )


def stamp(now: datetime, as_type: T.DataType | None = None) -> Column:
    """A point in time as a literal TIMESTAMP, or TIMESTAMP_NTZ in UTC.

    A naive ``now`` is UTC. ``F.lit`` would read it in the zone of the driver's machine.
    """
    naive = now.astimezone(UTC).replace(tzinfo=None) if now.tzinfo else now
    if isinstance(as_type, T.TimestampNTZType):
        return F.lit(naive.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.timestamp_micros(F.lit((naive - datetime(1970, 1, 1)) // timedelta(microseconds=1)))


def utc_naive(instant: Column | str) -> Column:
    """TIMESTAMP_NTZ that shows a TIMESTAMP in UTC."""
    instant = F.col(instant) if isinstance(instant, str) else instant
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)
