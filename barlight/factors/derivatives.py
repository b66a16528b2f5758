"""Factors of derivatives markets."""

from __future__ import annotations

from pyspark.sql import Column

from ..functions.series import SeriesFrame
from ..operators.registry import FactorFunction, Params, register_factor


@register_factor(category="crypto-specific", default_params={"fast": 8, "slow": 24})
def funding_momentum(params: Params) -> FactorFunction:
    """Fast less slow moving average of the funding rate; needs a column funding_rate, as an as-of join gives it."""

    def factor(s: SeriesFrame) -> Column:
        fr = s.col("funding_rate")
        return s.rolling_mean(fr, params.get("fast", 8)) - s.rolling_mean(fr, params.get("slow", 24))

    return factor
