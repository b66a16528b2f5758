"""Registry of factor families: factories that make a factor from parameters.

A factor takes a SeriesFrame and gives a Column, so that all factors of a table run in one plan. Factors that need
pandas are wrapped by pandas_factor().
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from copy import deepcopy
from dataclasses import dataclass, fields
from math import isinf
from typing import Any, Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import BLOCK, HALO, own_rows, with_halo
from ..functions.series import SeriesFrame
from .reach import reaches
from .schemas import FACTOR_INPUT, SERIES

Params = dict[str, Any]


@runtime_checkable
class FactorFunction(Protocol):
    """Computes a factor of every row from the series up to that row; null where it can't be computed."""

    def __call__(self, frame: SeriesFrame) -> Column: ...


class BaseFactor(ABC):
    """A factor as a class with parameters; its instances are factor functions."""

    @property
    def name(self) -> str:
        return type(self).__name__

    @abstractmethod
    def compute(self, frame: SeriesFrame) -> Column: ...

    def __call__(self, frame: SeriesFrame) -> Column:
        return self.compute(frame)


Factory = Callable[[Params], FactorFunction]


@dataclass(frozen=True)
class Family:
    """A factory with what the registry tells of it. Parameters are copied in and out, so that no caller changes them."""

    factory: Factory
    category: str
    description: str
    default_params: Params

    def enter(self, name: str, families: dict[str, Family]) -> None:
        if families.setdefault(name, self) is not self:
            raise ValueError(f"factor {name!r} exists already")

    def build(self, params: Params | None) -> FactorFunction:
        return self.factory(deepcopy(self.default_params if params is None else params))

    def told(self) -> dict[str, Any]:
        return {f.name: deepcopy(getattr(self, f.name)) for f in fields(self)}


FACTOR_REGISTRY: dict[str, Family] = {}


def register_factor(name: str | None = None, *, category: str = "uncategorised", description: str = "", default_params: Params | None = None) -> Callable[[Factory], Factory]:
    """Put a factory into the registry under a new name, its own by default."""

    def put(factory: Factory) -> Factory:
        told = description or (factory.__doc__ or "").strip()
        Family(factory, category, told, deepcopy(default_params or {})).enter(name if name is not None else factory.__name__, FACTOR_REGISTRY)
        return factory

    return put


def _family(name: str) -> Family:
    if name not in FACTOR_REGISTRY:
        raise KeyError(f"no factor {name!r}; there are {sorted(FACTOR_REGISTRY)}")
    return FACTOR_REGISTRY[name]


def get_factor_metadata(name: str) -> dict[str, Any]:
    return _family(name).told()


def build_factor(name: str, params: Params | None = None) -> FactorFunction:
    """Given parameters stand for the defaults as a whole: {} means none. The factory gets a copy."""
    return _family(name).build(params)


def list_factors(category: str | None = None) -> list[str]:
    return [n for n, f in FACTOR_REGISTRY.items() if category is None or f.category == category]


def validate_factor_input(df: DataFrame) -> None:
    missing = [c for c in FACTOR_INPUT if c not in df.columns]
    if missing:
        raise ValueError(f"factor input lacks {missing}")


def compute_factors(df: DataFrame, factors: dict[str, tuple[str, Params | None]], keys: Sequence[str] = SERIES, time: str = "open_time_utc") -> DataFrame:
    """The rows with a column for each of ``factors`` (column -> name, parameters), all over one shuffle and sort."""
    validate_factor_input(df)
    frame = SeriesFrame(df, keys, time)
    values = {}
    for column, (name, params) in factors.items():
        value = build_factor(name, params)(frame)
        if not isinstance(value, Column):
            raise TypeError(f"factor {name!r} must give a Column")
        values[column] = frame.let(value)
    return frame.finish(**values)


def compute_factors_in_blocks(df: DataFrame, factors: dict[str, tuple[str, Params | None]], keys: Sequence[str] = SERIES, time: str = "open_time_utc", width: str = "30 DAYS") -> DataFrame:
    """As compute_factors(), with series cut into blocks of time, so that a series may be most of the table. Factors whose windows have no bound are refused."""
    validate_factor_input(df)
    rows = lookback(factors, df, keys, time)
    if isinf(rows):
        raise ValueError("a factor without a bounded lookback can't be computed in blocks")
    return own_rows(compute_factors(with_halo(df, keys, time, int(rows), width), factors, [*keys, BLOCK], time))


def compute_factor(name: str, df: DataFrame, params: Params | None = None, keys: Sequence[str] = SERIES, time: str = "open_time_utc", column: str = "value") -> DataFrame:
    return compute_factors(df, {column: (name, params)}, keys, time)


def lookback(factors: dict[str, tuple[str, Params | None]], df: DataFrame, keys: Sequence[str] = SERIES, time: str = "open_time_utc") -> float:
    """How many bars before its own a value of any of these factors hangs on, worked out from their windows over a table like ``df``; infinite without bound."""
    empty = df.sparkSession.createDataFrame([], df.schema)
    return max((r.back for r in reaches(compute_factors(empty, factors, keys, time), list(factors), time).values()), default=0)


def panel(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = SERIES, time: str = "open_time_utc") -> DataFrame:
    """Wide factor columns to long rows: keys, time, factor_name, value."""
    return df.select(*keys, time, *columns).unpivot([*keys, time], list(columns), "factor_name", "value")


def pandas_factor(function: Callable[[pd.DataFrame], pd.Series], df: DataFrame, keys: Sequence[str] = SERIES, time: str = "open_time_utc", column: str = "value", lookback: int | None = None, width: str = "30 DAYS") -> DataFrame:
    """A factor written in pandas, series by series: keys, time and value.

    The function gets a series indexed by time and must give a value for each of its times. With ``lookback``, the number of bars before its own that a value hangs on,
    it gets a block of time with so many bars before it, so that no series is held as a whole.
    """
    validate_factor_input(df)
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in (*keys, time)), f"{column} double"])
    rows = df if lookback is None else with_halo(df, keys, time, lookback, width)

    def each(series: pd.DataFrame) -> pd.DataFrame:
        ordered = series.sort_values(time)
        given = ordered.drop(columns=[BLOCK, HALO], errors="ignore").set_index(time)
        values = function(given)
        if not isinstance(values, pd.Series):
            raise TypeError("a pandas factor must give a Series")
        if not values.index.equals(given.index):
            raise ValueError("a pandas factor must give a value for each time")
        out = given[list(keys)].assign(**{column: values.astype(float)}).reset_index()
        out[column] = out[column].astype(object).where(out[column].notna(), None)
        own = out if lookback is None else out[~ordered[HALO].to_numpy()]
        return own[[*keys, time, column]]

    return rows.groupBy(*[F.col(k) for k in keys], *([] if lookback is None else [F.col(BLOCK)])).applyInPandas(each, schema)
