"""Candle intervals and their lengths."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Interval names and their length in milliseconds.
INTERVAL_MS = {
    "1m": 60_000,
    "3m": 180_000,
    "5m": 300_000,
    "15m": 900_000,
    "30m": 1_800_000,
    "1h": 3_600_000,
    "2h": 7_200_000,
    "4h": 14_400_000,
    "6h": 21_600_000,
    "8h": 28_800_000,
    "12h": 43_200_000,
    "1d": 86_400_000,
    "3d": 259_200_000,
    "1w": 604_800_000,
}
MONTH = "1M"


def canonical_interval(name: str) -> str:
    """Exact names first, so that the month keeps its capital; else lower case."""
    return name if name == MONTH or name in INTERVAL_MS else name.lower()


def interval_ms(name: str) -> int:
    if name == MONTH:
        raise ValueError("a month has no fixed length")
    if name not in INTERVAL_MS:
        raise ValueError(f"unknown interval: {name!r}")
    return INTERVAL_MS[name]


def interval_ms_column(name: Column) -> Column:
    """Length in milliseconds, null for unknown names and months."""
    return F.element_at(F.create_map(*map(F.lit, chain.from_iterable(INTERVAL_MS.items()))), name)
