"""Series cut into blocks of time, so that one long series runs in many tasks.

A block gets the last rows of the blocks before it, its halo: as many as its windows look back. What is worked out in a block for its own rows is then what the whole
series gives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BLOCK, HALO = "_block", "_halo"


def microseconds(width: str | int) -> Column:
    """The length of an interval; numbers stay."""
    if not isinstance(width, str):
        return F.lit(width)
    return F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {width}"))


def time_block(df: DataFrame, time: str, width: str | int, name: str | None = None) -> Column:
    """The number of the block that a time lies in; times that are numbers count as microseconds. ``name``: what the column ``time`` of ``df`` is called now."""
    t, kind = F.col(name or time), df.schema[time].dataType
    at = F.unix_micros(t.cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else t
    return F.floor(at / microseconds(width)).cast("long")


def with_halo(df: DataFrame, keys: Sequence[str], time: str, rows: int, width: str | int) -> DataFrame:
    """The rows with their block, and again with ``_halo`` in each block behind that needs them: those of which fewer than ``rows`` lie between.

    A block has at most ``rows`` rows of others, also where blocks before it are short or missing. No key is gathered as a whole: rows are numbered from
    the end within their block, and which blocks follow is told by a table of the blocks' numbers of rows.
    """
    keys = list(keys)
    own = df.withColumn(BLOCK, time_block(df, time, width))
    if rows <= 0:
        return own.withColumn(HALO, F.lit(False))
    counts = own.groupBy(*keys, BLOCK).agg(F.count("*").alias("_n"))
    # blocks that follow, with the rows that lie between; each has a row at least, so that the halo ends within as many blocks as it has rows
    series = Window.partitionBy(*keys).orderBy(BLOCK)
    following = F.collect_list(F.struct(F.col(BLOCK).alias("b"), F.col("_upto").alias("u"), F.col("_n").alias("n"))).over(series.rowsBetween(1, rows))
    table = counts.withColumn("_upto", F.sum("_n").over(series.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", following)
    between = F.transform("_next", lambda x: F.struct(x["b"].alias("b"), (x["u"] - x["n"] - F.col("_upto")).alias("between")))
    near = table.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(BLOCK).alias("_kb"), F.filter(between, lambda x: x["between"] < rows).alias("_near"))
    behind = F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(F.desc(time))) - 1
    same = F.col(BLOCK).eqNullSafe(F.col("_kb"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    sent = own.withColumn("_behind", behind).join(near, same)
    to = F.filter("_near", lambda x: x["between"] + F.col("_behind") < rows)
    places = F.concat(F.array(F.struct(F.col(BLOCK).alias("b"), F.lit(False).alias("h"))), F.transform(to, lambda x: F.struct(x["b"].alias("b"), F.lit(True).alias("h"))))
    return sent.withColumn("_place", F.explode(places)).select(*df.columns, F.col("_place.b").alias(BLOCK), F.col("_place.h").alias(HALO))


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.col(HALO)).drop(BLOCK, HALO)
