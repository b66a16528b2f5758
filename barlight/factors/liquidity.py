"""Volume and liquidity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.series import SeriesFrame, ratio
from ..operators.registry import FactorFunction, Params, register_factor

CATEGORY = "volume-liquidity"


@register_factor(category=CATEGORY, default_params={"window": 20})
def volume_change(params: Params) -> FactorFunction:
    """Volume against its moving average, less 1."""
    return lambda s: ratio(s.col("volume"), s.rolling_mean(s.col("volume"), params.get("window", 20))) - 1.0


@register_factor(category=CATEGORY, default_params={"window": 20})
def turnover_rate(params: Params) -> FactorFunction:
    """Traded value against its moving average."""
    return lambda s: ratio(s.col("quote_volume"), s.rolling_mean(s.col("quote_volume"), params.get("window", 20)))


@register_factor(category=CATEGORY, default_params={"window": 20})
def amihud(params: Params) -> FactorFunction:
    """Mean move for traded value: a stand-in for depth."""

    def factor(s: SeriesFrame) -> Column:
        move = ratio(s.col("close"), s.lag(s.col("close"))) - 1.0
        return s.rolling_mean(s.let(ratio(F.abs(move), s.col("quote_volume"))), params.get("window", 20))

    return factor


@register_factor(category=CATEGORY)
def taker_imbalance(params: Params) -> FactorFunction:
    """Buyers' share of the volume, from -1 to 1."""
    return lambda s: 2.0 * ratio(s.col("taker_buy_volume"), s.col("volume")) - 1.0
