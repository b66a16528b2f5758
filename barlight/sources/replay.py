"""Recorded exchange data as a Spark source, and downloads from it.

A client reads files of recorded messages in the range [start, end), at most
``limit`` of each symbol in the order of time. There is no network access: the recordings stand for the exchange.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from datetime import datetime
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identifiers import segment
from ..functions.intervals import canonical_interval
from ..functions.timeutil import to_unix_ms
from ..operators.ingest import parse_funding, parse_trades, parse_wire_klines, strict, whole
from ..operators.schemas import BRONZE_COLUMNS
from .files import BRONZE_PARTS, read_lake_bronze
from .layout import series_names
from .recorded import register

DEFAULT_LIMIT = 1000


class ExchangeClient(ABC):
    """What an exchange gives for one symbol."""

    def __init__(self, symbol: str):
        self.symbol = segment(symbol, field="symbol", case="upper")

    @property
    @abstractmethod
    def exchange_name(self) -> str: ...

    @abstractmethod
    def fetch_klines(self, interval: str, start: datetime, end: datetime, limit: int = DEFAULT_LIMIT) -> DataFrame: ...

    @abstractmethod
    def fetch_trades(self, start: datetime, end: datetime, limit: int = DEFAULT_LIMIT) -> DataFrame: ...

    @abstractmethod
    def fetch_funding_rate(self, start: datetime, end: datetime, limit: int = DEFAULT_LIMIT) -> DataFrame: ...

    @abstractmethod
    def ping(self) -> bool: ...


def earliest(df: DataFrame, time: str, limit: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The first ``limit`` rows of each symbol."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(time))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def recorded_klines(spark: SparkSession, root: str, symbols: Sequence[str], interval: str, start: datetime, end: datetime) -> DataFrame:
    """Candles of all these symbols in [start, end), by one scan and one check; the symbol is that of the path.

    Messages whose time is out of the range are left out before they are read in full, as an exchange doesn't send them.
    """
    interval = canonical_interval(segment(interval, field="interval"))
    names = [segment(s, field="symbol", case="upper") for s in symbols]
    lines = spark.read.text([f"{root.rstrip('/')}/klines/{n}/{interval}" for n in dict.fromkeys(names)])
    at = whole(F.get_json_object("value", "$[0]"))
    asked = lines.where(at.isNull() | ((at >= to_unix_ms(start)) & (at < to_unix_ms(end))))
    placed = asked.select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3).alias("symbol"))
    return strict(parse_wire_klines(placed, F.col("symbol"), interval))


class ReplayClient(ExchangeClient):
    """Reads ``root``/klines/SYMBOL/interval, ``root``/trades/SYMBOL and ``root``/funding/SYMBOL: a JSON message in each line. Only files and messages of the time asked for are read."""

    def __init__(self, spark: SparkSession, root: str, symbol: str, name: str = "replay"):
        super().__init__(symbol)
        self.spark, self.root, self.name = spark, root.rstrip("/"), name

    @property
    def exchange_name(self) -> str:
        return self.name

    def _messages(self, kind: str, start: datetime, end: datetime, **options: str) -> DataFrame:
        register(self.spark)
        lines = self.spark.read.format("recorded").options(root=self.root, kind=kind, symbol=self.symbol, **options).load()
        return lines.where((F.col("at") >= to_unix_ms(start)) & (F.col("at") < to_unix_ms(end)))

    def fetch_klines(self, interval: str, start: datetime, end: datetime, limit: int = DEFAULT_LIMIT) -> DataFrame:
        rows = parse_wire_klines(self._messages("klines", start, end, interval=interval), F.col("symbol"), canonical_interval(interval))
        return earliest(strict(rows), "open_time", limit)

    def fetch_trades(self, start: datetime, end: datetime, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return earliest(strict(parse_trades(self._messages("trades", start, end).select("value"))), "timestamp", limit)

    def fetch_funding_rate(self, start: datetime, end: datetime, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return earliest(strict(parse_funding(self._messages("funding", start, end).select("value"))), "timestamp", limit)

    def ping(self) -> bool:
        try:
            self.spark.read.text(self.root, recursiveFileLookup=True).isEmpty()
        except AnalysisException:
            return False
        return True


class Downloader:
    """Candles of many symbols into Bronze. Bars that are there already are not written again, so that a broken run can be resumed."""

    def __init__(self, spark: SparkSession, root: str, bronze: str, exchange: str = "replay", market: str = "spot"):
        self.spark, self.root, self.bronze, self.exchange, self.market = spark, root, bronze, exchange, market

    def new_bars(self, symbols: Sequence[str], interval: str, start: datetime, end: datetime) -> DataFrame:
        keys = ["symbol", "interval", "open_time"]
        rows = recorded_klines(self.spark, self.root, symbols, interval, start, end).dropDuplicates(keys)
        try:
            there = read_lake_bronze(self.spark, self.bronze)
        except FileNotFoundError:
            return rows
        # another exchange's or market's candles of the same name are others
        place = series_names(self.exchange, self.market, "x", interval)
        own = (F.col("exchange") == place["exchange"]) & (F.col("market") == place["market"]) & (F.col("interval") == place["interval"])
        between = (F.col("open_time") >= to_unix_ms(start)) & (F.col("open_time") < to_unix_ms(end))
        return rows.join(there.where(own & between).select(*keys), keys, "left_anti")

    def download_all(self, symbols: Sequence[str], interval: str, start: datetime, end: datetime) -> str:
        """Append the new bars as a batch of their own, whose name is given back."""
        rows, batch = self.new_bars(symbols, interval, start, end).select(*BRONZE_COLUMNS), uuid4().hex
        place = series_names(self.exchange, self.market, "x", interval)
        placed = rows.withColumns({c: F.lit(place[c]) for c in ("exchange", "market")} | {"batch": F.lit(batch)})
        placed.write.mode("append").option("compression", "zstd").partitionBy(*BRONZE_PARTS).parquet(self.bronze)
        return batch

    def download_klines(self, symbol: str, interval: str, start: datetime, end: datetime) -> str:
        return self.download_all([symbol], interval, start, end)
