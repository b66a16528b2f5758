"""The contract of clean candles: one aggregate over the table, the first broken rule raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.identifiers import is_safe_segment
from .schemas import AMOUNTS, PRICES, SERIES, SILVER_COLUMNS


class ContractError(ValueError):
    """A rule of the contract is broken."""

    def __init__(self, rule: str, n: int | None = None):
        self.rule, self.n = rule, n
        super().__init__(rule if n is None else f"{rule}: {n} rows")


def has_columns(df: DataFrame, required: Sequence[str]) -> bool:
    return set(required) <= set(df.columns)


def row_rules() -> list[tuple[str, Column]]:
    """What each row by itself must not be, in the order in which rules are reported; the checks of times come first."""
    c, numeric = F.col, [*PRICES, *AMOUNTS]
    missing = lambda n: c(n).isNull() | F.isnan(c(n).cast("double"))
    any_of = lambda cs: F.coalesce(sum((F.coalesce(x, F.lit(False)).cast("int") for x in cs), F.lit(0)), F.lit(0)) > 0
    return [
        ("close before open time", c("close_time_utc") < c("open_time_utc")),
        ("number missing", any_of([missing(n) for n in numeric])),
        ("price not over 0", any_of([c(n) <= 0 for n in PRICES])),
        ("prices out of order", (c("high") < F.greatest("open", "close", "low")) | (c("low") > F.least("open", "close", "high"))),
        ("amount below 0", any_of([c(n) < 0 for n in AMOUNTS])),
        ("symbol or interval empty", any_of([c(n).isNull() | (c(n) == "") for n in SERIES])),
    ]


SAFE_NAMES = "symbol or interval is no safe name"
TIME_RULES = ("close before open time", "duplicate times", "times out of order")


def contract_rules() -> list[str]:
    """The rules in the order in which they are reported."""
    return [*TIME_RULES, *(name for name, _ in row_rules() if name not in TIME_RULES), SAFE_NAMES]


def judged(rows: DataFrame, parts: Sequence[str]) -> DataFrame:
    """The rows with the first rule of the contract that they break as ``broken``, null for good ones. Of rows with equal times of a series all but one break a rule.

    ``parts``: columns by which rows of a series with equal times are dealt to the same place; that takes the only shuffle.
    """
    before = F.lag("open_time_utc").over(Window.partitionBy(*parts).orderBy("open_time_utc"))
    safe = is_safe_segment(F.col("symbol")) & is_safe_segment(F.col("interval"))
    bad = dict(row_rules()) | {"duplicate times": F.col("open_time_utc") == before, "times out of order": F.col("open_time_utc").isNull(), SAFE_NAMES: ~safe}
    return rows.withColumn("broken", F.coalesce(*[F.when(F.coalesce(bad[r], F.lit(False)), F.lit(r)) for r in contract_rules()]))


def violations(df: DataFrame, keys: Sequence[str] = SERIES, ordinal: str | None = None) -> DataFrame:
    """One row of counts: rows, duplicate times, times out of order and each row rule.

    Rows have no order of their own; with a column ``ordinal`` that tells the order of arrival, times must rise along it within each series.
    Duplicates are counted by series and time, which also holds when a series is most of the table.
    """
    counted = df
    late = F.lit(0)
    if ordinal:
        arrival = Window.partitionBy(*keys).orderBy(ordinal)
        before = F.lag("open_time_utc").over(arrival)
        counted = df.withColumn("_late", F.when(F.col("open_time_utc").isNull() | (F.col("open_time_utc") < before), 1).otherwise(0))
        late = F.col("_late")
    else:
        late = F.when(F.col("open_time_utc").isNull(), 1).otherwise(0)
    rules = row_rules()
    # first by series and time, which is where duplicates show; the counts of the rules ride along
    by_time = counted.groupBy(*keys, "open_time_utc").agg(F.count("*").alias("n"), F.sum(late).alias("late"), *[F.sum(F.coalesce(bad, F.lit(False)).cast("int")).alias(f"r{i}") for i, (_, bad) in enumerate(rules)])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by_time.agg(total("n").alias("rows"), total(F.col("n") - 1).alias("duplicate times"), total("late").alias("times out of order"), *[total(f"r{i}").alias(name) for i, (name, _) in enumerate(rules)])


def validate_klines(df: DataFrame, keys: Sequence[str] = SERIES, ordinal: str | None = None) -> None:
    """Raise a ContractError for the first broken rule: columns, rows, types, times, then values."""
    if not has_columns(df, SILVER_COLUMNS):
        raise ContractError(f"columns missing: {sorted(set(SILVER_COLUMNS) - set(df.columns))}")
    types = {n: df.schema[n].dataType for n in SILVER_COLUMNS}
    found = violations(df, keys, ordinal).first().asDict() if all(isinstance(types[n], (T.NumericType, T.BooleanType)) for n in (*PRICES, *AMOUNTS)) and all(isinstance(types[n], (T.TimestampType, T.TimestampNTZType)) for n in ("open_time_utc", "close_time_utc")) else None
    if found["rows"] == 0 if found else df.isEmpty():
        raise ContractError("no rows")
    for n in ("open_time_utc", "close_time_utc"):
        if not isinstance(types[n], T.TimestampType):
            raise ContractError(f"{n} is not an instant")
    if df.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ContractError("session time zone is not UTC")
    for rule in TIME_RULES if found else ():
        if found[rule]:
            raise ContractError(rule, found[rule])
    for n in (*PRICES, *AMOUNTS):
        if not isinstance(types[n], (T.NumericType, T.BooleanType)):
            raise ContractError(f"{n} is not a number")
    if not isinstance(types["num_trades"], T.IntegralType):
        raise ContractError("num_trades is not whole")
    for rule, n in found.items():
        if rule not in ("rows", *TIME_RULES) and n:
            raise ContractError(rule, n)
