"""Trend and momentum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.series import SeriesFrame, above_zero, ratio
from ..operators.registry import BaseFactor, FactorFunction, Params, register_factor

CATEGORY = "momentum"


@register_factor(category=CATEGORY, default_params={"window": 20})
def sma_dev(params: Params) -> FactorFunction:
    """Distance of the close from its simple moving average, as a share of it."""
    n = params.get("window", 20)

    def factor(s: SeriesFrame) -> Column:
        mean = s.rolling_mean(s.col("close"), n)
        return ratio(s.col("close") - mean, mean)

    return factor


class RSI(BaseFactor):
    """Relative strength from simple means of gains and losses; 100 without losses, null without moves."""

    def __init__(self, window: int = 14):
        self.window = window

    def compute(self, frame: SeriesFrame) -> Column:
        delta = frame.let(frame.col("close") - frame.lag(frame.col("close")))
        gain, loss = (frame.rolling_mean(above_zero(x), self.window) for x in (delta, -delta))
        return F.when((loss == 0) & (gain > 0), 100.0).when(loss > 0, 100.0 - 100.0 / (1.0 + ratio(gain, loss)))


@register_factor(category=CATEGORY, default_params={"window": 14})
def rsi(params: Params) -> FactorFunction:
    """Relative strength index."""
    return RSI(params.get("window", 14))


@register_factor(category=CATEGORY, default_params={"window": 5})
def momentum(params: Params) -> FactorFunction:
    """Return over a number of bars."""
    n = params.get("window", 5)
    return lambda s: ratio(s.col("close"), s.lag(s.col("close"), n)) - 1.0


@register_factor(category=CATEGORY, default_params={"window": 5})
def return_momentum(params: Params) -> FactorFunction:
    """Sum of single-bar returns over a number of bars."""
    n = params.get("window", 5)

    def factor(s: SeriesFrame) -> Column:
        return s.rolling_sum(s.let(ratio(s.col("close"), s.lag(s.col("close"))) - 1.0), n)

    return factor
