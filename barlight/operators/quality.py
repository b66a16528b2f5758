"""Gaps and outliers of candle series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import MONTH, interval_ms
from .schemas import SERIES


def missing_klines(df: DataFrame, interval: str, keys: Sequence[str] = SERIES, time: str = "open_time_utc", months: bool = False) -> DataFrame:
    """Times of each series' grid, from its first to its last time, at which it has no row. Times off the grid fill no place.

    Months have no fixed length and are refused unless ``months``; then each is the same day of the next month.
    """
    if interval == MONTH and months:
        step = F.expr("INTERVAL 1 MONTH")
    else:
        step = F.make_dt_interval(secs=F.lit(interval_ms(interval) / 1000))
    span = df.groupBy(*keys).agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    grid = span.select(*keys, F.explode(F.sequence("_first", "_last", step)).alias(time))
    return grid.join(df.select(*keys, time).distinct(), [*keys, time], "left_anti")


def outlier_mask(df: DataFrame, column: str, n_std: float = 5.0, keys: Sequence[str] = (), out: str = "is_outlier") -> DataFrame:
    """The rows with a mask: further than ``n_std`` sample standard deviations from the mean, of the table or of each series.

    Text is read as numbers where it is one. A deviation of zero, of none or of NaN marks nothing. With 26 rows or fewer
    nothing can be five deviations away.
    """
    if column not in df.columns:
        raise ValueError(f"no such column: {column!r}")
    if n_std <= 0:
        raise ValueError("n_std must be over 0")
    value = F.col(column).try_cast("double")
    value = F.when(~F.isnan(value), value)
    stats = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # without keys there is one row of statistics
    joined = df.join(stats, same) if keys else df.crossJoin(F.broadcast(stats))
    far = (F.abs(value - F.col("_mean")) > n_std * F.col("_std")) & ~F.isnan("_std") & (F.col("_std") != 0)
    return joined.select(*df.columns, F.coalesce(far, F.lit(False)).alias(out))

