"""Recorded messages to typed rows: candles, trades and funding rates.

Wire candles are JSON arrays of twelve mixed elements, the last of which is unused. Rows that break a rule are told by
the rule's name in a column, so that a job can reject, count or set them aside; ``strict`` raises on the first kind found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import is_safe_segment
from ..functions.intervals import canonical_interval
from .schemas import BRONZE_COLUMNS

WIRE_LENGTH = 12
OFFSET = r"(?:Z|z|[+-]\d{2}:?\d{2})\s*$"


class InvalidRecords(ValueError):
    """Some records break a rule: how many break which."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        super().__init__(", ".join(f"{k}: {n}" for k, n in counts.items()))


def first_broken(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that a row breaks, in the given order; null for a good row. A rule that is null is broken."""
    return F.coalesce(*[F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in rules])


def strict(df: DataFrame, column: str = "broken") -> DataFrame:
    """The rows without the column, or an error with the counts of broken rules."""
    counts = {r[column]: r["count"] for r in df.where(F.col(column).isNotNull()).groupBy(column).count().collect()}
    if counts:
        raise InvalidRecords(counts)
    return df.drop(column)


def number(value: Column) -> Column:
    """A double, also from a numeric string; null if it is none. NaN becomes null, infinity stays."""
    d = value.try_cast("double")
    return F.when(~F.isnan(d), d)


def whole(value: Column) -> Column:
    """A long; null for fractions."""
    d = value.try_cast("decimal(38,9)")
    return F.when(d == F.floor(d), d).try_cast("long")


def price_rules(open_: str = "open_time", close: str = "close_time") -> list[tuple[str, Column]]:
    c = F.col
    return [
        *((f"{p} over 0", c(p) > 0) for p in ("open", "high", "low", "close")),
        *((f"{a} at least 0", c(a) >= 0) for a in ("volume", "quote_asset_volume", "number_of_trades", "taker_buy_base_volume", "taker_buy_quote_volume")),
        ("times at least 0", (c(open_) >= 0) & (c(close) >= 0)),
        ("close time after open time", c(close) >= c(open_)),
        ("high is highest", c("high") >= F.greatest("open", "close", "low")),
        ("low is lowest", c("low") <= F.least("open", "close", "high")),
    ]


def parse_wire_klines(df: DataFrame, symbol: str | Column, interval: str, value: str = "value") -> DataFrame:
    """JSON arrays to Bronze rows with the column ``broken``. symbol: one for all, or a column."""
    a = F.from_json(F.col(value), "array<string>")
    at = lambda i: F.get("_a", F.lit(i))
    fields = [("open_time", 0, whole), ("open", 1, number), ("high", 2, number), ("low", 3, number), ("close", 4, number), ("volume", 5, number), ("close_time", 6, whole), ("quote_asset_volume", 7, number), ("number_of_trades", 8, whole), ("taker_buy_base_volume", 9, number), ("taker_buy_quote_volume", 10, number)]
    named = F.upper(F.lit(symbol) if isinstance(symbol, str) else symbol)
    rows = df.select(a.alias("_a"), named.alias("symbol")).select("_a", *[kind(at(i)).alias(n) for n, i, kind in fields], "symbol", F.lit(canonical_interval(interval)).alias("interval"))
    rules = [("twelve elements", F.size("_a") == WIRE_LENGTH), *price_rules(), ("safe symbol", is_safe_segment(F.col("symbol"))), ("safe interval", is_safe_segment(F.col("interval")))]
    return rows.withColumn("broken", first_broken(rules)).select(*BRONZE_COLUMNS, "broken")


def _time(column: str) -> tuple[Column, Column]:
    """An instant from text that names its offset or from epoch milliseconds, and whether it does."""
    text = F.col(column)
    return F.when(text.rlike(OFFSET), text.try_cast("timestamp")), text.rlike(OFFSET) & text.try_cast("timestamp").isNotNull()


def _only(json: str, names: tuple[str, ...]) -> Column:
    """Whether an object has no other keys."""
    return F.size(F.array_except(F.json_object_keys(json), F.array(*map(F.lit, names)))) == 0


def parse_trades(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON objects to trades with the column ``broken``."""
    names = ("timestamp", "price", "quantity", "side", "symbol")
    rows = df.select(F.col(value).alias("_j"), F.from_json(value, ", ".join(f"{n} string" for n in names)).alias("_o")).select("_j", "_o.*")
    at, good = _time("timestamp")
    rows = rows.select("_j", good.alias("_zone"), at.alias("timestamp"), number(F.col("price")).alias("price"), number(F.col("quantity")).alias("quantity"), "side", "symbol")
    rules = [("no other fields", _only("_j", names)), ("time with zone", F.col("_zone")), ("price over 0", F.col("price") > 0), ("quantity over 0", F.col("quantity") > 0), ("side is buy or sell", F.col("side").isin("buy", "sell")), ("symbol", F.col("symbol") != "")]
    return rows.withColumn("broken", first_broken(rules)).drop("_j", "_zone")


def parse_funding(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON objects to funding rates with the column ``broken``."""
    names = ("timestamp", "funding_rate", "symbol")
    rows = df.select(F.col(value).alias("_j"), F.from_json(value, ", ".join(f"{n} string" for n in names)).alias("_o")).select("_j", "_o.*")
    at, good = _time("timestamp")
    rows = rows.select("_j", good.alias("_zone"), at.alias("timestamp"), number(F.col("funding_rate")).alias("funding_rate"), "symbol")
    rules = [("no other fields", _only("_j", names)), ("time with zone", F.col("_zone")), ("rate", F.col("funding_rate").isNotNull()), ("symbol", F.col("symbol") != "")]
    return rows.withColumn("broken", first_broken(rules)).drop("_j", "_zone")
