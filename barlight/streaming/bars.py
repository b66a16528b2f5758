"""Streaming candles and incremental refresh of the layers.

Streams that append keep as state only what the watermark leaves open: windows and keys older than the latest time less the delay are given or forgotten, and rows that
come after that are left out. A stream that has ended is closed by a sentinel, a row so late that it closes all windows but its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.layout import Lake
from ..sources.refresh import changes, merge_silver


def stream_bars(trades: DataFrame, length: str, time: str, price: str, quantity: str, symbol: str, late: str = "1 hour") -> DataFrame:
    """Candles of a stream of trades by tumbling windows; trades later than ``late`` are left out once their window has been given."""
    rows = trades.where(F.col(price) > 0).withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    at = F.struct(F.col("_t"), F.col(price).alias("p"))
    bars = rows.groupBy(F.window("_t", length), F.col(symbol).cast("string").alias("symbol")).agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.max(price).alias("high"), F.min(price).alias("low"), F.round(F.sum(quantity), 4).alias("volume"), F.count("*").alias("num_trades"))
    return bars.select("symbol", F.col("window.start").alias("open_time"), F.col("_first.p").alias("open"), "high", "low", F.col("_last.p").alias("close"), "volume", "num_trades")


def distinct_rows(stream: DataFrame, keys: Sequence[str], time: str, late: str = "1 hour") -> DataFrame:
    """The rows of a stream without repetitions of the same keys that come within ``late`` of each other; keys are forgotten then. ``time`` is an instant."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def with_sentinels(stream: DataFrame, folder: str) -> DataFrame:
    """The stream with the rows of sentinel files in ``folder``."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def put_sentinel(spark: SparkSession, schema: StructType, folder: str, **values: Any) -> None:
    """A sentinel row with these values, null in other columns. It closes what is open when the stream runs next; its own window stays open, so that it isn't given itself."""
    spark.createDataFrame([tuple(values.get(f) for f in schema.names)], schema).coalesce(1).write.mode("append").parquet(folder)


def run_append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there to the table at ``path`` and stop; each batch once, also after a failure. The next run with the same checkpoint goes on from there."""
    query = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_available(bars: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there and stop; the candles are the table at ``path``, written by the executors anew with each batch."""
    bars.sparkSession.createDataFrame([], bars.schema).write.mode("ignore").parquet(path)
    query = bars.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return bars.sparkSession.read.schema(bars.schema).parquet(path)


def refresh_silver(arrived: DataFrame, lake: Lake, refresh: Callable[[DataFrame], None] | None = None, quarantine: bool = False) -> None:
    """Merge a batch of clean candles into Silver; for use in foreachBatch. ``refresh`` gets the batch's series with the first and last time that changed, to recompute factors there."""
    merge_silver(arrived, lake, quarantine)
    if refresh:
        refresh(changes(arrived))


def stream_into_silver(spark: SparkSession, source: DataFrame, lake: Lake, checkpoint: str, refresh: Callable[[DataFrame], None] | None = None, quarantine: bool = False) -> StreamingQuery:
    """A stream of clean candles into Silver, batch by batch, until what is there is done. A batch that is given again after a failure changes nothing."""
    query = source.writeStream.foreachBatch(lambda df, _: refresh_silver(df, lake, refresh, quarantine)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
