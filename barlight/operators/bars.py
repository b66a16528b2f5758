"""Candles from trades, and the candle panels over the table ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def trades_to_bars(trades: DataFrame, interval: str, bucket: Column, length: str, time: str = "timestamp", price: str = "price", quantity: str = "quantity", symbol: str = "symbol", bought: Column | None = None) -> DataFrame:
    """Candles of each symbol and time bucket; ``length`` is the bucket's as an SQL interval. Prices of 0 or less don't count.

    First and last price are those of the least and greatest time. ``bought`` tells trades that a buyer began.
    """
    notional = F.col(price) * F.col(quantity)
    side = bought if bought is not None else F.lit(False)
    rows = trades.where(F.col(price) > 0).withColumn("open_time", bucket)
    bars = rows.groupBy(F.col(symbol).cast("string").alias("symbol"), "open_time").agg(
        F.min_by(price, time).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, time).alias("close"),
        F.round(F.sum(quantity), 4).alias("volume"),
        F.round(F.sum(notional), 4).alias("quote_volume"),
        F.round(F.coalesce(F.sum(F.when(side, F.col(quantity))), F.lit(0.0)), 4).alias("taker_buy_volume"),
        F.round(F.coalesce(F.sum(F.when(side, notional)), F.lit(0.0)), 4).alias("taker_buy_quote_volume"),
        F.count("*").alias("num_trades"),
    )
    close = F.expr(f"open_time + INTERVAL {length} - INTERVAL 0.001 SECOND")
    return bars.select("symbol", F.lit(interval).alias("interval"), "open_time", close.alias("close_time"), "open", "high", "low", "close", "volume", "quote_volume", "taker_buy_volume", "taker_buy_quote_volume", "num_trades")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles of each event type; even event ids are buyers' trades."""
    bucket = F.date_trunc("HOUR", "ts").cast("timestamp_ntz")
    return trades_to_bars(_events(spark, sf_dir), "1h", bucket, "1 HOUR", "ts", "value", "value", "event_type", F.col("event_id") % 2 == 0)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles of each user."""
    bucket = F.date_trunc("DAY", "ts").cast("timestamp_ntz")
    return trades_to_bars(_events(spark, sf_dir), "1d", bucket, "1 DAY", "ts", "value", "value", "user_id", F.col("event_id") % 2 == 0)


def as_silver(bars: DataFrame) -> DataFrame:
    """Bars under the names, types and order of Silver."""
    from .schemas import SILVER_COLUMNS

    times = {"open_time": "open_time_utc", "close_time": "close_time_utc"}
    return bars.withColumnsRenamed(times).withColumns({t: F.col(t).cast("timestamp") for t in times.values()}).select(*SILVER_COLUMNS)


def funding_rates(spark: SparkSession, sf_dir: str, event_type: str = "view") -> DataFrame:
    """A stand-in for funding rates: eight-hour averages of one event type, a hundredth of them, known when their bucket ends."""
    rows = _events(spark, sf_dir).where((F.col("event_type") == event_type) & (F.col("value") > 0))
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 28800) * 28800).cast("timestamp_ntz")
    return rows.groupBy(bucket.alias("start")).agg(F.round(F.avg("value") / 100, 6).alias("funding_rate")).select(F.expr("start + INTERVAL 8 HOURS").alias("funding_time"), "funding_rate")
