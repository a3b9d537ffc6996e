"""Timestamp normalisation: the reference data model keeps local-time text, ordered by real time here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = "yyyy-MM-dd HH:mm:ss"
MINUTE = "yyyy-MM-dd HH:mm"
# fixed value: epoch numbers above this are milliseconds, others seconds
EPOCH_MS_FLOOR = 10_000_000_000
MAX_MS = 253_402_300_799_999


def has_offset(raw: Column) -> Column:
    return raw.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")


def instant(raw: Column) -> Column:
    """TIMESTAMP of an RFC 3339 text, null for anything else."""
    return F.when(has_offset(raw), F.try_to_timestamp(raw))


def local_text(raw: Column) -> Column:
    """RFC 3339 becomes local text; any other text swaps ``T`` for a blank and keeps 19 characters."""
    return F.coalesce(F.date_format(instant(raw), SECOND), F.left(F.replace(raw, F.lit("T"), F.lit(" ")), F.lit(19)))


def epoch_text(value: Column, fmt: str = SECOND) -> Column:
    """Epoch seconds or milliseconds, told apart by size."""
    value = value.cast("bigint")
    return millis_text(F.when(F.abs(value) > EPOCH_MS_FLOOR, value).otherwise(value * 1000), fmt)


def millis_text(value: Column, fmt: str = SECOND) -> Column:
    """Text of epoch milliseconds; values beyond the year 9999 are unreadable and give null."""
    return F.date_format(F.timestamp_millis(F.when(F.abs(value) <= MAX_MS, value)), fmt)
