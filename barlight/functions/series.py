"""Windows over one series, with the null rules of rolling statistics in one place.

A rolling value needs a full window of values; otherwise it is null. NaN counts as null. Divisions by zero give null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def clean(value: Column) -> Column:
    """Null for NaN: it would compare as greater than any number."""
    return F.when(~F.isnan(value), value)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def above_zero(value: Column) -> Column:
    """The value where positive, else 0; null stays null."""
    return F.when(value > 0, value).when(value.isNotNull(), F.lit(0.0))


class SeriesFrame:
    """A table of series being computed on: its keys, its time column, and columns put in on the way.

    All windows share one partitioning and order, so that they need one shuffle and one sort together.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], time: str):
        self.df, self.keys, self.time = df, list(keys), time
        self._extra: list[str] = []

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.time)

    def col(self, name: str) -> Column:
        return clean(F.col(name).cast("double"))

    def let(self, value: Column) -> Column:
        """Name an intermediate value, as windows over windows need."""
        name = f"_v{len(self._extra)}"
        self.df = self.df.withColumn(name, value)
        self._extra.append(name)
        return F.col(name)

    def lag(self, value: Column, n: int = 1) -> Column:
        return F.lag(value, n).over(self.window)

    def _full(self, value: Column, n: int, result: Column) -> Column:
        return F.when(F.count(value).over(self._frame(n)) >= n, result)

    def _frame(self, n: int) -> WindowSpec:
        return self.window.rowsBetween(-(n - 1), 0)

    def rolling_mean(self, value: Column, n: int) -> Column:
        return self._full(value, n, F.avg(value).over(self._frame(n)))

    def rolling_sum(self, value: Column, n: int) -> Column:
        return self._full(value, n, F.sum(value).over(self._frame(n)))

    def rolling_std(self, value: Column, n: int) -> Column:
        return self._full(value, n, F.stddev_samp(value).over(self._frame(n)))

    def finish(self, **values: Column) -> DataFrame:
        """The table with the named results and without what was put in on the way."""
        return self.df.withColumns(values).drop(*self._extra)
