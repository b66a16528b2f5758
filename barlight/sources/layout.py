"""Where the layers lie: partitioned tables under one root, and the path of a single series."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from ..functions.identifiers import inside, segment
from ..functions.intervals import canonical_interval

FORMATS = ("parquet", "json")


@dataclass(frozen=True)
class Lake:
    """Layer tables under a root, which may be any URI that Spark can write to.

    ``bucket``: the pattern by which times are dealt into buckets, whose names must sort as their times do.
    """

    root: str
    bucket: str = "yyyy-MM"

    def table(self, layer: str, name: str) -> str:
        return f"{self.root.rstrip('/')}/{layer}/{name}"

    @property
    def bronze(self) -> str:
        return self.table("bronze", "klines")

    @property
    def silver(self) -> str:
        return self.table("silver", "klines")

    @property
    def gold(self) -> str:
        return self.table("gold", "factors")

    @property
    def quarantine(self) -> str:
        return self.table("quarantine", "klines")

    @property
    def log(self) -> str:
        return self.table("log", "batches")


def series_names(exchange: str, market: str, symbol: str, interval: str) -> dict[str, str]:
    """Safe names in the case that paths use, by partition column."""
    return {
        "exchange": segment(exchange, field="exchange", case="lower"),
        "market": segment(market, field="market", case="lower"),
        "symbol": segment(symbol, field="symbol", case="upper"),
        "interval": canonical_interval(segment(interval, field="interval")),
    }


def bronze_klines_path(root: str | Path, *, exchange: str, symbol: str, interval: str, market: str = "spot", file_format: str = "parquet") -> Path:
    kind = file_format.lstrip(".").lower()
    if kind not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}: {file_format!r}")
    return inside(root, "bronze", *series_names(exchange, market, symbol, interval).values(), f"klines.{kind}")


def silver_klines_path(root: str | Path, *, exchange: str, symbol: str, interval: str, market: str = "spot") -> Path:
    return inside(root, "silver", *series_names(exchange, market, symbol, interval).values(), "klines.parquet")


def gold_factor_path(root: str | Path, *, exchange: str, symbol: str, interval: str, factor_name: str, market: str = "spot") -> Path:
    return inside(root, "gold", *series_names(exchange, market, symbol, interval).values(), f"{segment(factor_name, field='factor_name')}.parquet")
