"""Volatility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.series import SeriesFrame, ratio
from ..operators.registry import FactorFunction, Params, register_factor

CATEGORY = "volatility"


def log_return(s: SeriesFrame) -> Column:
    r = ratio(s.col("close"), s.lag(s.col("close")))
    return s.let(F.when(r > 0, F.log(r)))


@register_factor(category=CATEGORY, default_params={"window": 20})
def hist_vol(params: Params) -> FactorFunction:
    """Sample standard deviation of log returns."""
    return lambda s: s.rolling_std(log_return(s), params.get("window", 20))


@register_factor(category=CATEGORY, default_params={"window": 20})
def realized_vol(params: Params) -> FactorFunction:
    """Root of the sum of squared returns."""

    def factor(s: SeriesFrame) -> Column:
        r = s.let(ratio(s.col("close"), s.lag(s.col("close"))) - 1.0)
        return F.sqrt(s.rolling_sum(r * r, params.get("window", 20)))

    return factor


@register_factor(category=CATEGORY, default_params={"short": 5, "long": 20})
def vol_reversion(params: Params) -> FactorFunction:
    """Short volatility against long, less 1."""

    def factor(s: SeriesFrame) -> Column:
        r = log_return(s)
        return ratio(s.rolling_std(r, params.get("short", 5)), s.rolling_std(r, params.get("long", 20))) - 1.0

    return factor
