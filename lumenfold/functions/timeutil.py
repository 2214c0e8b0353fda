"""Boundary-crossing time differences and UTC calendar helpers.

The metric definitions count *boundary crossings*, not elapsed time: the
minute difference between 12:00:59 and 12:30:00 is 30, the second difference
between x.9 s and (x+1).1 s is 1. ``timestampdiff`` measures elapsed time, so
it is never used here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def second_diff(start: Column | str, end: Column | str) -> Column:
    """Number of whole-second boundaries crossed from ``start`` to ``end`` (bigint)."""
    return F.unix_seconds(_col(end)) - F.unix_seconds(_col(start))


def minute_diff(start: Column | str, end: Column | str) -> Column:
    """Number of minute boundaries crossed from ``start`` to ``end`` (bigint)."""
    return F.floor(F.unix_seconds(_col(end)) / 60) - F.floor(F.unix_seconds(_col(start)) / 60)


def utc_date(ts: Column | str) -> Column:
    """Calendar date of an instant in UTC, independent of the session time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(_col(ts)) / 86400).cast("int"))


def minute_floor(ts: Column | str) -> Column:
    """Instant truncated to its UTC minute (time-zone independent)."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(_col(ts)) / 60) * 60)


def epoch_millis(ts: Column | str) -> Column:
    return F.unix_millis(_col(ts))


def late_flag(event_time: Column | str, received_at: Column | str, hours: int) -> Column:
    """Strictly more than ``hours`` between event and receipt (microsecond precision)."""
    return F.unix_micros(_col(received_at)) - F.unix_micros(_col(event_time)) > F.lit(
        hours * 3600 * 1_000_000
    )


def naive_utc(df, columns=None):
    """Render TimestampType columns as UTC wall-clock ``timestamp_ntz``.

    Stored Parquet/DuckDB tables use naive UTC timestamps; entry points pin the
    session zone to UTC (``session.ensure_utc``), under which the cast is exact.
    """
    from pyspark.sql import types as T

    targets = columns or [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)
    ]
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in targets})
