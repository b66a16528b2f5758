"""Checks against look-ahead: a factor's value may hang on nothing after its time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reach import reaches
from .schemas import SERIES

Compute = Callable[[DataFrame], DataFrame]


def prefix_mismatches(compute: Compute, df: DataFrame, cuts: Sequence, time: str = "open_time_utc", keys: Sequence[str] = SERIES, column: str | Sequence[str] = "value", tolerance: float = 1e-9) -> DataFrame:
    """cut, n_rows, n_mismatch: at each cut, the factor from the rows up to it against the factor from all rows.

    ``compute`` gives the rows with the factor's column, or those of several; a factor that looks ahead changes when later rows
    are taken away. A row mismatches if one of its factors does. No cuts give no rows.
    """
    columns = [column] if isinstance(column, str) else list(column)
    if not cuts:
        return df.groupBy(F.col(time).alias("cut")).agg(F.count("*").alias("n_rows"), F.lit(0).cast("long").alias("n_mismatch")).limit(0)
    full = compute(df).select(*keys, time, *[F.col(c).alias(f"_full{i}") for i, c in enumerate(columns)])
    parts = []
    for cut in cuts:
        part = compute(df.where(F.col(time) <= F.lit(cut))).where(F.col(time) == F.lit(cut)).select(*keys, time, *[F.col(c).alias(f"_part{i}") for i, c in enumerate(columns)])
        parts.append(part)
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    joined = both.join(full, [*keys, time])
    same = F.lit(True)
    for i in range(len(columns)):
        a, b = F.col(f"_full{i}"), F.col(f"_part{i}")
        same &= F.coalesce(F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a)), F.lit(False)) | a.eqNullSafe(b)
    return joined.groupBy(F.col(time).alias("cut")).agg(F.count("*").alias("n_rows"), F.sum((~same).cast("long")).alias("n_mismatch"))


def changed_by_later_rows(compute: Compute, df: DataFrame, cut: Any, columns: Sequence[str], time: str = "open_time_utc", keys: Sequence[str] = SERIES, tolerance: float = 1e-9) -> DataFrame:
    """name, n_rows, n_changed: for each column, how many of the rows up to the cut get another value when the rows behind it are taken away."""
    on = [*keys, time]
    full = compute(df).where(F.col(time) <= F.lit(cut)).select(*on, *[F.col(c).alias(f"_full{i}") for i, c in enumerate(columns)])
    part = compute(df.where(F.col(time) <= F.lit(cut))).select(*on, *[F.col(c).alias(f"_part{i}") for i, c in enumerate(columns)])
    a, b = lambda i: F.col(f"_full{i}"), lambda i: F.col(f"_part{i}")
    same = lambda i: F.coalesce(F.abs(a(i) - b(i)) <= tolerance * F.greatest(F.lit(1.0), F.abs(a(i))), F.lit(False)) | a(i).eqNullSafe(b(i))
    counts = full.join(part, on).agg(F.count("*").alias("n_rows"), *[F.sum((~same(i)).cast("long")).alias(f"n{i}") for i in range(len(columns))])
    told = F.array(*[F.struct(F.lit(c).alias("name"), F.col("n_rows"), F.coalesce(f"n{i}", F.lit(0)).alias("n_changed")) for i, c in enumerate(columns)])
    return counts.select(F.explode(told).alias("e")).select("e.*")


def looks_ahead(df: DataFrame, columns: Sequence[str] | None = None, time: str = "open_time_utc") -> list[str]:
    """Those of the columns (all by default) that hang on rows of later times, by a walk through the analysed plan: leads, frames that reach behind the own row, whole
    partitions, and joins with rows whose time is later. What functions in Python do can't be seen, and so counts as looking ahead.
    """
    return [c for c, r in reaches(df, columns or df.columns, time).items() if r.ahead > 0]


def timestamp_alignment(factor: DataFrame, data: DataFrame, time: str = "open_time_utc", keys: Sequence[str] = SERIES) -> DataFrame:
    """One row: n_rows, n_duplicate and n_unmatched of the factor's times against the data's."""
    on = [*keys, time]
    counted = factor.groupBy(*on).agg(F.count("*").alias("_n"))
    known = data.select(*on).distinct().withColumn("_known", F.lit(True))
    return counted.join(known, on, "left").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicate"), F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n")).otherwise(0)), F.lit(0)).alias("n_unmatched"))


def check_timestamp_alignment(factor: DataFrame, data: DataFrame, time: str = "open_time_utc", keys: Sequence[str] = SERIES) -> bool:
    r = timestamp_alignment(factor, data, time, keys).first()
    return r["n_duplicate"] == 0 and r["n_unmatched"] == 0


def forward_return_alignment(factor: DataFrame, returns: DataFrame, keys: Sequence[str], available: str = "available_at", start: str = "ret_start", end: str = "ret_end") -> DataFrame:
    """One row: n_rows, n_unmatched keys on either side, n_misaligned pairs that break available <= start < end."""
    a, b = factor.select(*keys, available), returns.select(*keys, start, end)
    joined = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), list(keys), "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    good = F.coalesce((F.col(available) <= F.col(start)) & (F.col(start) < F.col(end)), F.lit(False))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return joined.agg(F.count("*").alias("n_rows"), count(~both).alias("n_unmatched"), count(both & ~good).alias("n_misaligned"))


def check_forward_return_alignment(factor: DataFrame, returns: DataFrame, keys: Sequence[str], available: str = "available_at", start: str = "ret_start", end: str = "ret_end") -> bool:
    r = forward_return_alignment(factor, returns, keys, available, start, end).first()
    return r["n_unmatched"] == 0 and r["n_misaligned"] == 0
