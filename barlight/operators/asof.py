"""As-of join: each row with the latest value that was known at its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.blocks import time_block

WIDTH = "7 DAYS"


def asof_backward(left: DataFrame, right: DataFrame, left_time: str, right_time: str, values: Sequence[str], keys: Sequence[str] = (), width: str | int = WIDTH) -> DataFrame:
    """left with ``values`` of the last right row at or before its time, by keys; null if there is none. Of right rows with equal times that with the greatest values counts.

    Both sides are dealt by keys and time blocks of ``width`` (an interval, or a number for times that are numbers), so that neither a long series nor a side without keys
    meets in one task. Each block gets the value that was the last before it from a small table of the blocks' last values; in the block left and
    right rows run through one window. A right side without keys is shared by all left rows: it isn't multiplied. Rows without time find nothing.
    """
    keys = list(keys)
    made = F.struct(*values)
    right_rows = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("_t"), F.lit(1).alias("_side"), made.alias("_value")).withColumn("_block", time_block(right, right_time, width, "_t"))
    left_rows = left.withColumns({"_t": F.col(left_time), "_side": F.lit(2), "_block": time_block(left, left_time, width)})
    # what stands before each block that left rows are in: one row a block and key
    lasts = right_rows.groupBy(*keys, "_block").agg(F.max(F.struct("_t", "_value")).alias("_last"))
    asked = left_rows.select(*keys, "_block").distinct().withColumn("_asked", F.lit(True))
    before = Window.partitionBy(*keys).orderBy("_block", F.col("_asked").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    both = lasts.unionByName(asked, allowMissingColumns=True)
    # a block's own last value stands behind its question
    carried = both.withColumn("_value", F.last("_last", ignorenulls=True).over(before)["_value"]).where("_asked and _value is not null").select(*keys, "_block", F.lit(0).alias("_side"), "_value")
    rows = left_rows.unionByName(right_rows, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_block").orderBy("_t", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_value", ignorenulls=True).over(inside)
    return rows.withColumn("_last", last).where(F.col("_side") == 2).select(*left.columns, *[F.when(F.col(left_time).isNotNull(), F.col(f"_last.{v}")).alias(v) for v in values])
