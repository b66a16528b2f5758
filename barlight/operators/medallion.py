"""Bronze to Silver to factor input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import is_safe_segment
from ..functions.intervals import INTERVAL_MS, MONTH
from .schemas import BRONZE_COLUMNS, PRICES, RENAMED, SERIES, SILVER_COLUMNS
from .validate import ContractError, validate_klines


def silver_projection(bronze: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Types, names and order of Silver, lazily and unchecked. Further columns are dropped but for those in ``keep``, which stand last."""
    named = bronze.withColumnsRenamed(RENAMED)
    interval = F.when(F.col("interval").isin(MONTH, *INTERVAL_MS), F.col("interval")).otherwise(F.lower("interval"))
    made = {
        "open_time_utc": F.timestamp_millis(F.col("open_time").cast("long")),
        "close_time_utc": F.timestamp_millis(F.col("close_time").cast("long")),
        "symbol": F.upper("symbol"),
        "interval": interval,
        "num_trades": F.col("num_trades").cast("long"),
    }
    return named.select(*[made[c].alias(c) if c in made else F.col(c).cast("double").alias(c) for c in SILVER_COLUMNS], *keep)


def bronze_to_silver(bronze: DataFrame, keys: Sequence[str] = SERIES, ordinal: str | None = None) -> DataFrame:
    """Checked Silver rows. The check is one job; the rows themselves stay lazy."""
    missing = sorted(set(BRONZE_COLUMNS) - set(bronze.columns))
    if missing:
        raise ContractError(f"columns missing: {missing}")
    silver = silver_projection(bronze)
    unsafe = silver.where(~(is_safe_segment(F.col("symbol")) & is_safe_segment(F.col("interval"))))
    if not unsafe.isEmpty():
        raise ContractError("symbol or interval is no safe name")
    if ordinal:
        validate_klines(_with_ordinal(bronze, ordinal), keys, "_ordinal")
    else:
        validate_klines(silver, keys)
    return silver


def _with_ordinal(bronze: DataFrame, ordinal: str) -> DataFrame:
    named = bronze.withColumn("_ordinal", F.col(ordinal)).withColumnsRenamed(RENAMED)
    times = {"open_time_utc": F.timestamp_millis(F.col("open_time").cast("long")), "close_time_utc": F.timestamp_millis(F.col("close_time").cast("long"))}
    return named.withColumns(times | {p: F.col(p).cast("double") for p in PRICES}).select(*SILVER_COLUMNS, "_ordinal")


def factor_input(silver: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Checked Silver rows with the time from which a bar's values are known."""
    validate_klines(silver, keys)
    return silver.withColumn("available_at", F.col("close_time_utc"))
