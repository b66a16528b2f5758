"""UTC times from text, numbers and datetimes, and back to milliseconds."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
UNITS = ("s", "ms")


def to_utc(value: str | float | datetime, *, numeric_unit: str | None = None) -> datetime:
    """A UTC datetime. Times without a zone count as UTC; numbers need a unit, 's' or 'ms'."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value.strip())
    elif isinstance(value, (int, float)):
        if numeric_unit not in UNITS:
            raise ValueError("numbers need numeric_unit 's' or 'ms'")
        return EPOCH + (timedelta(seconds=value) if numeric_unit == "s" else timedelta(milliseconds=value))
    elif isinstance(value, date) and not isinstance(value, datetime):
        raise TypeError(f"no time of day: {value!r}")
    elif not isinstance(value, datetime):
        raise TypeError(f"not a time: {type(value).__name__}")
    return value.replace(tzinfo=UTC) if value.tzinfo is None else value.astimezone(UTC)


def to_unix_ms(value: str | float | datetime, *, numeric_unit: str | None = None) -> int:
    """Whole milliseconds since 1970, rounded down; exact, unlike a product of float seconds."""
    return (to_utc(value, numeric_unit=numeric_unit) - EPOCH) // timedelta(milliseconds=1)


def now_utc() -> datetime:
    return datetime.now(UTC)


def utc_column(value: Column, unit: str | None = None) -> Column:
    """Column form of to_utc(): unit None for text with or without an offset (session zone UTC), else for numbers."""
    if unit is None:
        return F.to_timestamp(value)
    if unit not in UNITS:
        raise ValueError("unit must be 's' or 'ms'")
    return F.timestamp_seconds(value) if unit == "s" else F.timestamp_millis(value.cast("long"))


def unix_ms_column(value: Column) -> Column:
    return F.unix_millis(value.cast("timestamp"))
