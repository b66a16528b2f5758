"""Places, ranks and n-tiles of groups that are too large for one task.

Rows are dealt by ranges of group and value and numbered through: a table of the ranges' sizes gives each its first number. Equal values may lie in several ranges;
the groups of equal values at the ranges' edges are put together in a table with a few rows for each range. No row is joined on its value to others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder

#: A table with a row for each range, or two, is sent to the tasks up to so many; above, it is joined by a shuffle.
BROADCAST_RANGES = 200_000


def _sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_RANGES else table


def _joined(df: DataFrame, table: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Joined by columns in which null equals null."""
    named, same = table.withColumnsRenamed({c: f"_j{i}" for i, c in enumerate(columns)}), F.lit(True)
    for i, c in enumerate(columns):
        same &= F.col(c).eqNullSafe(F.col(f"_j{i}"))
    return df.join(named, same, how).drop(*[f"_j{i}" for i in range(len(columns))])


def placed(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with ``_pos``, their number from 1 within ``by`` in this order, and ``_size``, how many rows the group has; rows that are equal in it get any numbers. ``_part``: the range."""
    shared_folder(df.sparkSession)
    keys = [*by, *order, "_tie"]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    # a partition's number stands in the upper bits of this id, and the place in the partition in the lower 33
    at = ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).checkpoint()
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = at.groupBy(*by, "_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_n")).checkpoint()
    table = sizes.select(*by, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low") + 1).alias("_shift"), F.sum("_n").over(whole).alias("_size"))
    return _joined(at, _sent(table), [*by, "_part"]).withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_at", "_shift")


def average_ranks(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows with their rank from 1 within ``by``; equal values share the mean of their ranks. Filter nulls out first."""
    rows = placed(df, by, [value])
    group = [*by, value]
    here = Window.partitionBy("_part", *group)
    rows = rows.withColumns({"_first": F.min("_pos").over(here), "_same": F.count("*").over(here)}).checkpoint()
    # the first and last values of each range; those in several ranges are one group
    edge = Window.partitionBy("_part", *by)
    ends = rows.groupBy("_part", *group).agg(F.min("_first").alias("_first"), F.max("_same").alias("_same")).withColumns({"_least": F.min("_first").over(edge), "_most": F.max("_first").over(edge)}).where("_first = _least or _first = _most")
    met = ends.groupBy(*group).agg(F.min("_first").alias("_first0"), F.sum("_same").alias("_same0"), F.count("*").alias("_parts")).where("_parts > 1").drop("_parts").checkpoint()
    whole = _joined(rows, _sent(met), group, "left")
    rank = F.coalesce("_first0", "_first") + (F.coalesce("_same0", "_same") - 1) / 2
    return whole.withColumn(out, rank).select(*df.columns, out)


def ntile_of(n: int, pos: Column, size: Column) -> Column:
    """The n-tile of a place among ``size``: sizes differ by one at most, larger ones first."""
    small, more = F.floor(size / n), size % n
    large = more * (small + 1)
    return F.when(pos <= large, F.ceil(pos / (small + 1))).otherwise(more + F.ceil((pos - large) / F.greatest(small, F.lit(1)))).cast("int")


def ntiles(df: DataFrame, n: int, order: Sequence[str], out: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows with their n-tile within ``by``, as ntile() gives it; rows that are equal in the order may change places."""
    return placed(df, by, order).withColumn(out, ntile_of(n, F.col("_pos"), F.col("_size"))).select(*df.columns, out)
