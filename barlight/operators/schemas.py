"""Schemas of the layers. Nothing in the candle path is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


D, L, S, TS = T.DoubleType(), T.LongType(), T.StringType(), T.TimestampType()

#: Raw candles as recorded: millisecond times and the exchange's names.
BRONZE_KLINE = _fields(("open_time", L), ("open", D), ("high", D), ("low", D), ("close", D), ("volume", D), ("close_time", L), ("quote_asset_volume", D), ("number_of_trades", L), ("taker_buy_base_volume", D), ("taker_buy_quote_volume", D), ("symbol", S), ("interval", S))
#: Clean candles; the order of the columns is fixed.
SILVER_KLINE = _fields(("open_time_utc", TS), ("close_time_utc", TS), ("open", D), ("high", D), ("low", D), ("close", D), ("volume", D), ("quote_volume", D), ("taker_buy_volume", D), ("taker_buy_quote_volume", D), ("num_trades", L), ("symbol", S), ("interval", S))
TRADE = _fields(("timestamp", TS), ("price", D), ("quantity", D), ("side", S), ("symbol", S))
FUNDING = _fields(("timestamp", TS), ("funding_rate", D), ("symbol", S))

BRONZE_COLUMNS = tuple(BRONZE_KLINE.names)
SILVER_COLUMNS = tuple(SILVER_KLINE.names)
FACTOR_INPUT = ("open", "high", "low", "close", "volume")
PRICES = ("open", "high", "low", "close")
AMOUNTS = ("volume", "quote_volume", "taker_buy_volume", "taker_buy_quote_volume", "num_trades")
RENAMED = {"quote_asset_volume": "quote_volume", "number_of_trades": "num_trades", "taker_buy_base_volume": "taker_buy_volume"}
SERIES = ("symbol", "interval")
