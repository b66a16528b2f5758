"""Queries by name over the candle panels of the table ``events``, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import factors as _catalogue  # noqa: F401  registers the factors
from ..functions.identifiers import is_safe_segment
from ..functions.intervals import interval_ms_column
from ..functions.timeutil import unix_ms_column, utc_column
from ..operators import bars, evaluate, forward_check, ingest, medallion, quality, validate
from ..operators.asof import asof_backward
from ..operators.registry import compute_factor, compute_factors, compute_factors_in_blocks, list_factors, pandas_factor
from ..operators.schemas import SILVER_COLUMNS
from ..session import shared_folder
from ..sources import files, refresh, replay
from ..sources.layout import Lake
from ..streaming import bars as streaming

Query = Callable[[SparkSession, str], DataFrame]
SERIES_TIME = {"keys": ("symbol",), "time": "open_time"}
DIGITS = 6

# ---- shared inputs


def _bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles under the raw names, with millisecond times."""
    b = bars.hourly_bars(spark, sf_dir)
    ms = lambda c: unix_ms_column(F.col(c)).alias(c)
    return b.select(ms("open_time"), "open", "high", "low", "close", "volume", ms("close_time"), F.col("quote_volume").alias("quote_asset_volume"), F.col("num_trades").alias("number_of_trades"), F.col("taker_buy_volume").alias("taker_buy_base_volume"), "taker_buy_quote_volume", F.lower("symbol").alias("symbol"), F.upper("interval").alias("interval"))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles with one-day momentum as value and the next day's return."""
    returns = evaluate.forward_returns(bars.daily_bars(spark, sf_dir), "1 DAY")
    return compute_factor("momentum", returns, {"window": 1}, **SERIES_TIME)


FACTORS = {"momentum_1": ("momentum", {"window": 1}), "sma_dev_3": ("sma_dev", {"window": 3}), "volume_change_3": ("volume_change", {"window": 3}), "taker_imbalance": ("taker_imbalance", None)}


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = evaluate.forward_returns(bars.daily_bars(spark, sf_dir), "1 DAY")
    return compute_factors(returns, FACTORS, **SERIES_TIME)


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir).select("symbol", "open_time", "fwd_ret", *FACTORS).unpivot(["symbol", "open_time", "fwd_ret"], list(FACTORS), "factor_name", "value")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def _naive(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


# ---- SQL of the same inputs

_AGGREGATES = """arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, round(sum(value), 4) AS volume,
 round(sum(value * value), 4) AS quote_volume, round(coalesce(sum(CASE WHEN event_id % 2 = 0 THEN value END), 0), 4) AS taker_buy_volume,
 round(coalesce(sum(CASE WHEN event_id % 2 = 0 THEN value * value END), 0), 4) AS taker_buy_quote_volume, count(*) AS num_trades"""


def _bars_sql(symbol: str, unit: str, interval: str) -> str:
    return f"""SELECT CAST({symbol} AS VARCHAR) AS symbol, '{interval}' AS "interval", date_trunc('{unit}', ts) AS open_time,
 date_trunc('{unit}', ts) + INTERVAL 1 {unit} - INTERVAL 1 MILLISECOND AS close_time, {_AGGREGATES} FROM events WHERE value > 0 GROUP BY {symbol}, date_trunc('{unit}', ts)"""


HOURLY = _bars_sql("event_type", "hour", "1h")
DAILY = _bars_sql("user_id", "day", "1d")
_W = "PARTITION BY symbol ORDER BY open_time"
_FWD = f"CASE WHEN lead(open_time) OVER ({_W}) = open_time + INTERVAL 1 DAY THEN lead(close) OVER ({_W}) / close - 1 END AS fwd_ret"
PANEL = f"SELECT *, {_FWD}, close / lag(close) OVER ({_W}) - 1 AS value FROM d"


def _with(*parts: tuple[str, str]) -> str:
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in parts) + " "


_D, _H, _P = ("d", DAILY), ("h", HOURLY), ("p", PANEL)


def _frame(n: int) -> str:
    return f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(aggregate: str, column: str, n: int) -> str:
    return f"CASE WHEN count({column}) OVER {_frame(n)} >= {n} THEN {aggregate}({column}) OVER {_frame(n)} END"


def _factor_sql(value: str, *stages: tuple[str, str], base: str = "h") -> str:
    """SELECT of symbol, open_time and value; each stage is (name, expression) put in before."""
    parts, last = [_H], base
    for i, (name, expression) in enumerate(stages):
        parts.append((f"s{i}", f"SELECT *, {expression} AS {name} FROM {last}"))
        last = f"s{i}"
    return _with(*parts) + f"SELECT symbol, open_time, round({value}, {DIGITS}) AS value FROM {last}"


_RET = ("r", f"close / lag(close) OVER ({_W}) - 1")
_LOG = ("lr", f"ln(close / lag(close) OVER ({_W}))")


def _corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def _ranks(source: str, x: str, y: str, by: str) -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / CAST(2 AS DOUBLE)"
    return f"SELECT {by}, {rank(x)} AS x, {rank(y)} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL"


_WIDE = f"""SELECT symbol, open_time, {_FWD}, close / lag(close) OVER ({_W}) - 1 AS momentum_1,
 (close - ({_full('avg', 'close', 3)})) / nullif({_full('avg', 'close', 3)}, 0) AS sma_dev_3,
 volume / nullif({_full('avg', 'volume', 3)}, 0) - 1 AS volume_change_3, 2 * taker_buy_volume / nullif(volume, 0) - 1 AS taker_imbalance FROM d"""
_UNPIVOT = " UNION ALL ".join(f"SELECT symbol, open_time, fwd_ret, '{f}' AS factor_name, {f} AS value FROM w" for f in FACTORS)
_IC = f"SELECT open_time, {_corr('x', 'y')} AS ic, count(*) AS n FROM r GROUP BY open_time HAVING count(*) >= 2"
_GROUPED = "SELECT *, ntile(5) OVER (PARTITION BY open_time ORDER BY value, symbol) AS bucket FROM p WHERE value IS NOT NULL AND fwd_ret IS NOT NULL"
_LS = "SELECT open_time, avg(CASE WHEN bucket = 5 THEN fwd_ret END) - avg(CASE WHEN bucket = 1 THEN fwd_ret END) AS gross FROM g GROUP BY open_time"
_HELD = "SELECT open_time, symbol, CASE WHEN bucket = 5 THEN 1 ELSE -1 END / CAST(count(*) OVER (PARTITION BY open_time, bucket) AS DOUBLE) AS w FROM g WHERE bucket IN (1, 5)"
_TIMES = "SELECT t, lead(t) OVER (ORDER BY t) AS nxt FROM (SELECT DISTINCT open_time AS t FROM held)"
_MOVES = "SELECT open_time, symbol, w FROM held UNION ALL SELECT nxt, symbol, -w FROM held JOIN times ON open_time = t WHERE nxt IS NOT NULL"
_TURN = "SELECT open_time, sum(abs(w)) / 2 AS turnover FROM (SELECT open_time, symbol, sum(w) AS w FROM moves GROUP BY open_time, symbol) GROUP BY open_time"
_COST = (_D, _P, ("g", _GROUPED), ("ls", _LS), ("held", _HELD), ("times", _TIMES), ("moves", _MOVES), ("turn", _TURN))

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


# ---- candles


@query(HOURLY)
def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.hourly_bars(spark, sf_dir)


@query(DAILY)
def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.daily_bars(spark, sf_dir)


@query(_with(_H) + "SELECT open_time AS open_time_utc, close_time AS close_time_utc, open, high, low, close, volume, quote_volume, taker_buy_volume, taker_buy_quote_volume, num_trades, upper(symbol) AS symbol, \"interval\" FROM h")
def silver_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(medallion.silver_projection(_bronze(spark, sf_dir)), "open_time_utc", "close_time_utc").select(*SILVER_COLUMNS)


@query(
    _with(_H, ("x", "SELECT *, CASE WHEN num_trades % 7 = 0 THEN low - 1 ELSE high END AS h2, CASE WHEN num_trades % 5 = 0 THEN NULL ELSE volume END AS v2, CASE WHEN num_trades % 3 = 0 THEN -1 ELSE num_trades END AS n2 FROM h"))
    + """SELECT (SELECT count(*) FROM x) AS n_rows, (SELECT count(*) FROM x) - (SELECT count(*) FROM (SELECT DISTINCT symbol, "interval", open_time FROM x)) AS n_duplicate_times,
 CAST(coalesce(sum(CASE WHEN close_time < open_time THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_close_early, CAST(sum(CASE WHEN v2 IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
 CAST(sum(CASE WHEN least(open, h2, low, close) <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_price,
 CAST(sum(CASE WHEN h2 < greatest(open, close, low) OR low > least(open, close, h2) THEN 1 ELSE 0 END) AS BIGINT) AS n_order,
 CAST(sum(CASE WHEN v2 < 0 OR n2 < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_amount FROM x"""
)
def kline_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over candles that were spoilt by rule: highs below lows, missing volumes, negative counts."""
    n = F.col("num_trades")
    spoilt = bars.as_silver(bars.hourly_bars(spark, sf_dir)).withColumns({"high": F.when(n % 7 == 0, F.col("low") - 1).otherwise(F.col("high")), "volume": F.when(n % 5 != 0, F.col("volume")), "num_trades": F.when(n % 3 == 0, F.lit(-1)).otherwise(n)})
    v = validate.violations(spoilt)
    names = {"rows": "n_rows", "duplicate times": "n_duplicate_times", "close before open time": "n_close_early", "number missing": "n_missing", "price not over 0": "n_price", "prices out of order": "n_order", "amount below 0": "n_amount"}
    return v.select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()])


@query(
    _with(_H, ("x", """SELECT CASE WHEN num_trades % 5 = 0 THEN '' ELSE upper(symbol) END AS symbol, CASE WHEN num_trades % 7 = 0 THEN NULL ELSE open_time END AS t,
 CASE WHEN num_trades % 6 = 0 THEN open_time - INTERVAL 1 SECOND ELSE close_time END AS close_time FROM h UNION ALL SELECT upper(symbol), open_time, close_time FROM h WHERE num_trades % 4 = 0"""))
    + """SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT symbol, t FROM x)) AS n_duplicate_times, CAST(sum(CASE WHEN t IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_late,
 CAST(sum(CASE WHEN close_time < t THEN 1 ELSE 0 END) AS BIGINT) AS n_close_early, CAST(sum(CASE WHEN symbol = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_nameless FROM x"""
)
def kline_time_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over candles with some times missing, some closes before the open, some rows twice and some names empty."""
    silver, n = bars.as_silver(bars.hourly_bars(spark, sf_dir)).withColumn("symbol", F.upper("symbol")), F.col("num_trades")
    again = silver.where(n % 4 == 0)
    close = F.when(n % 6 == 0, F.expr("open_time_utc - INTERVAL 1 SECOND")).otherwise(F.col("close_time_utc"))
    spoilt = silver.withColumn("close_time_utc", close).withColumns({"symbol": F.when(n % 5 == 0, "").otherwise(F.col("symbol")), "open_time_utc": F.when(n % 7 != 0, F.col("open_time_utc"))})
    names = {"rows": "n_rows", "duplicate times": "n_duplicate_times", "times out of order": "n_late", "close before open time": "n_close_early", "symbol or interval empty": "n_nameless"}
    return validate.violations(spoilt.unionByName(again)).select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()])


_WIRE = """SELECT *, CASE WHEN num_trades % 9 = 0 THEN 'twelve elements' WHEN num_trades % 7 = 0 THEN 'high over 0' WHEN num_trades % 5 = 0 THEN 'volume at least 0'
 WHEN num_trades % 4 = 0 THEN 'close time after open time' WHEN num_trades % 3 = 0 THEN 'high is highest' ELSE 'none' END AS rule FROM h"""


def _messages(hourly: DataFrame, spoilt: bool = False) -> DataFrame:
    """symbol and value: each candle as the message of an exchange, some of them spoilt."""
    n, ms = F.col("num_trades"), lambda c: unix_ms_column(F.col(c))
    put = lambda k, bad, good: F.when(n % k == 0, bad).otherwise(good) if spoilt else good
    text = lambda c: c.cast("string")
    close = put(4, ms("open_time") - 1, ms("close_time"))
    low = put(3, F.col("high") * 2, F.col("low"))
    fields = [text(ms("open_time")), text(F.col("open")), put(7, F.lit("none"), text(F.col("high"))), text(low), text(F.col("close")), put(5, F.lit("-1"), text(F.col("volume"))), text(close), text(F.col("quote_volume")), text(n), text(F.col("taker_buy_volume")), text(F.col("taker_buy_quote_volume")), F.lit("0")]
    whole = F.array(*fields)
    return hourly.select("symbol", F.to_json(put(9, F.slice(whole, 1, 11), whole)).alias("value"))


@query(_with(_H, ("x", _WIRE)) + "SELECT rule, count(*) AS n FROM x GROUP BY rule")
def wire_kline_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles as messages, some of them spoilt: how many break which rule first."""
    rows = ingest.parse_wire_klines(_messages(bars.hourly_bars(spark, sf_dir), True), F.col("symbol"), "1h")
    return rows.groupBy(F.coalesce("broken", F.lit("none")).alias("rule")).agg(F.count("*").alias("n"))


@query(_with(_H, ("x", _WIRE)) + "SELECT upper(symbol) AS symbol, open_time, open, high, low, close, volume, num_trades FROM x WHERE rule = 'none'")
def wire_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The good ones of these messages, as Bronze rows."""
    rows = ingest.parse_wire_klines(_messages(bars.hourly_bars(spark, sf_dir), True), F.col("symbol"), "1h").where(F.col("broken").isNull())
    return rows.select("symbol", F.timestamp_millis("open_time").cast("timestamp_ntz").alias("open_time"), "open", "high", "low", "close", "volume", F.col("number_of_trades").alias("num_trades"))


#: Recordings are read from the second day on, for ten days.
_RANGE = "open_time >= (SELECT date_trunc('day', min(open_time)) + INTERVAL 1 DAY FROM h) AND open_time < (SELECT date_trunc('day', min(open_time)) + INTERVAL 11 DAY FROM h)"


def _recorded(spark: SparkSession, sf_dir: str) -> tuple[str, list[str], datetime, datetime]:
    """Messages written as an exchange's recordings: their folder, the symbols and a range of ten days."""
    root, hourly = _temporary(spark), bars.hourly_bars(spark, sf_dir)
    placed = _messages(hourly).withColumns({"symbol": F.upper("symbol"), "interval": F.lit("1h")})
    # one folder for each symbol and interval, as recordings have them
    for (symbol,) in placed.select("symbol").distinct().collect():
        placed.where(F.col("symbol") == symbol).select("value").write.text(f"{root}/klines/{symbol}/1h")
    first = hourly.agg(F.date_trunc("DAY", F.min("open_time")).cast("timestamp_ntz")).first()[0].replace(tzinfo=timezone.utc)
    return root, sorted(r[0] for r in placed.select("symbol").distinct().collect()), first + timedelta(days=1), first + timedelta(days=11)


@query(_with(_H) + f"SELECT upper(symbol) AS symbol, open_time, close, num_trades FROM h WHERE {_RANGE}")
def replay_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols of a recording downloaded in two overlapping ranges; nothing stands twice."""
    root, symbols, start, end = _recorded(spark, sf_dir)
    loader = replay.Downloader(spark, root, f"{root}/bronze")
    loader.download_all(symbols[:2], "1h", start, start + (end - start) / 2)
    loader.download_all(symbols, "1h", start, end)
    rows = files.read_bronze_klines(spark, f"{root}/bronze")
    return rows.select("symbol", F.timestamp_millis("open_time").cast("timestamp_ntz").alias("open_time"), "close", F.col("number_of_trades").alias("num_trades"))


@query(_with(_H) + f"SELECT upper(symbol) AS symbol, open_time, close FROM h WHERE {_RANGE} AND symbol = (SELECT min(symbol) FROM h) ORDER BY open_time LIMIT 50")
def replay_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 candles of one symbol in a range: a fetch's limit."""
    root, symbols, start, end = _recorded(spark, sf_dir)
    rows = replay.ReplayClient(spark, root, symbols[0]).fetch_klines("1H", start, end, limit=50)
    return rows.select("symbol", F.timestamp_millis("open_time").cast("timestamp_ntz").alias("open_time"), "close")


@query("""SELECT event_id, value AS price, make_timestamp(epoch_us(ts) // 1000 * 1000) AS at FROM events WHERE value > 0 AND event_type = (SELECT min(event_type) FROM events)
 AND ts >= (SELECT date_trunc('day', min(ts)) FROM events) AND ts < (SELECT date_trunc('day', min(ts)) + INTERVAL 20 DAY FROM events)""")
def replay_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded trades of one symbol in a range of twenty days; the quantity carries the id."""
    root, e = _temporary(spark), spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("value") > 0)
    least, first = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min("event_type"), F.date_trunc("DAY", F.min("ts"))).first()
    at = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    message = F.struct(at.alias("timestamp"), F.col("value").cast("string").alias("price"), (F.col("event_id") + 1).cast("string").alias("quantity"), F.lit("buy").alias("side"), F.upper("event_type").alias("symbol"))
    e.where(F.col("event_type") == least).select(F.to_json(message).alias("value")).write.text(f"{root}/trades/{least.upper()}")
    start = first.replace(tzinfo=timezone.utc)
    rows = replay.ReplayClient(spark, root, least).fetch_trades(start, start + timedelta(days=20), limit=2**31 - 1)
    return rows.select((F.col("quantity") - 1).cast("long").alias("event_id"), "price", F.col("timestamp").cast("timestamp_ntz").alias("at"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN event_type || '/x' WHEN 2 THEN '..' WHEN 3 THEN '' WHEN 4 THEN event_type || '_1.a-b' ELSE ' ' || event_type END AS name,
 event_id % 6 IN (0, 4) AS safe FROM events""")
def safe_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that may or may not stand in a path."""
    e, k = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id") % 6
    name = F.when(k == 0, F.col("event_type")).when(k == 1, F.concat("event_type", F.lit("/x"))).when(k == 2, "..").when(k == 3, "").when(k == 4, F.concat("event_type", F.lit("_1.a-b"))).otherwise(F.concat(F.lit(" "), "event_type"))
    return e.select("event_id", name.alias("name")).withColumn("safe", is_safe_segment(F.col("name")))


@query(_with(_H, ("x", "SELECT *, CASE WHEN num_trades % 7 = 0 THEN low - 1 ELSE high END AS h2 FROM h")) + "SELECT symbol, open_time FROM x WHERE h2 < greatest(open, close, low) OR low > least(open, close, h2) OR h2 <= 0")
def invalid_ohlc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bronze(spark, sf_dir)
    spoilt = b.withColumn("high", F.when(F.col("number_of_trades") % 7 == 0, F.col("low") - 1).otherwise(F.col("high")))
    bad = spoilt.withColumn("broken", ingest.first_broken(ingest.price_rules())).where(F.col("broken").isNotNull())
    return bad.select("symbol", F.timestamp_millis("open_time").cast("timestamp_ntz").alias("open_time"))


@query(_with(_H, ("s", "SELECT symbol, min(open_time) AS a, max(open_time) AS b FROM h GROUP BY symbol"), ("g", "SELECT symbol, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS open_time FROM s")) + "SELECT symbol, open_time FROM g ANTI JOIN h USING (symbol, open_time)")
def missing_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_klines(bars.hourly_bars(spark, sf_dir), "1h", ("symbol",), "open_time")


@query("SELECT event_id, coalesce(abs(value - avg(value) OVER (PARTITION BY event_type)) > 3 * stddev_samp(value) OVER (PARTITION BY event_type), false) AS is_outlier FROM events")
def outlier_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.outlier_mask(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", 3.0, ("event_type",)).select("event_id", "is_outlier")


@query("SELECT event_type, CAST(sum(CASE WHEN o THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers, count(*) AS n_rows FROM (SELECT event_type, abs(value - (SELECT avg(value) FROM events)) > 3 * (SELECT stddev_samp(value) FROM events) AS o FROM events) GROUP BY event_type")
def outlier_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.outlier_mask(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", 3.0)
    return rows.groupBy("event_type").agg(F.sum(F.col("is_outlier").cast("long")).alias("n_outliers"), F.count("*").alias("n_rows"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, make_timestamp(epoch_us(ts) // 1000 * 1000) AS t FROM events")
def to_utc_ms_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = unix_ms_column(F.col("ts"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ms.alias("ms"), utc_column(ms, "ms").cast("timestamp_ntz").alias("t"))


# ---- factors

_MEAN20 = _full("avg", "close", 20)
_FACTOR_SQL = {
    "sma_dev": ({"window": 20}, "sma_dev", _factor_sql("(close - m) / nullif(m, 0)", ("m", _MEAN20))),
    "rsi_14": ({"window": 14}, "rsi", None),
    "rsi_7": ({"window": 7}, "rsi", None),
    "momentum": ({"window": 5}, "momentum", _factor_sql(f"close / nullif(lag(close, 5) OVER ({_W}), 0) - 1")),
    "return_momentum": ({"window": 5}, "return_momentum", _factor_sql("v", _RET, ("v", _full("sum", "r", 5)))),
    "hist_vol": ({"window": 20}, "hist_vol", _factor_sql("v", _LOG, ("v", _full("stddev_samp", "lr", 20)))),
    "realized_vol": ({"window": 20}, "realized_vol", _factor_sql("sqrt(v)", _RET, ("r2", "r * r"), ("v", _full("sum", "r2", 20)))),
    "vol_reversion": ({"short": 5, "long": 20}, "vol_reversion", _factor_sql("a / nullif(b, 0) - 1", _LOG, ("a", _full("stddev_samp", "lr", 5)), ("b", _full("stddev_samp", "lr", 20)))),
    "volume_change": ({"window": 20}, "volume_change", _factor_sql("volume / nullif(m, 0) - 1", ("m", _full("avg", "volume", 20)))),
    "turnover": ({"window": 20}, "turnover_rate", _factor_sql("quote_volume / nullif(m, 0)", ("m", _full("avg", "quote_volume", 20)))),
    "amihud": ({"window": 20}, "amihud", _factor_sql("v", _RET, ("i", "abs(r) / nullif(quote_volume, 0)"), ("v", _full("avg", "i", 20)))),
    "taker_imbalance": (None, "taker_imbalance", _factor_sql("2 * taker_buy_volume / nullif(volume, 0) - 1")),
}


def _rsi_sql(n: int) -> str:
    stages = (("d1", f"close - lag(close) OVER ({_W})"), ("gain", "CASE WHEN d1 IS NOT NULL THEN greatest(d1, 0) END"), ("loss", "CASE WHEN d1 IS NOT NULL THEN greatest(-d1, 0) END"), ("ag", _full("avg", "gain", n)), ("al", _full("avg", "loss", n)))
    return _factor_sql("CASE WHEN al = 0 AND ag > 0 THEN 100 WHEN al > 0 THEN 100 - 100 / (1 + ag / al) END", *stages)


def _factor_query(name: str, family: str, params: dict | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = compute_factor(family, bars.hourly_bars(spark, sf_dir), params, **SERIES_TIME)
        return rounded(out.select("symbol", "open_time", "value"), "value")

    run.__name__ = f"factor_{name}"
    return run


for _name, (_params, _family, _text) in _FACTOR_SQL.items():
    query(_text or _rsi_sql(_params["window"]))(_factor_query(_name, _family, _params))

_FUNDING = "SELECT time_bucket(INTERVAL 8 HOURS, ts, TIMESTAMP '1970-01-01') + INTERVAL 8 HOURS AS funding_time, round(avg(value) / 100, 6) AS funding_rate FROM events WHERE event_type = 'view' AND value > 0 GROUP BY 1"
_ASOF = "SELECT c.*, f.funding_rate FROM h c ASOF LEFT JOIN f ON c.open_time >= f.funding_time"


def _funded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates have no symbol: all share them."""
    return asof_backward(bars.hourly_bars(spark, sf_dir), bars.funding_rates(spark, sf_dir), "open_time", "funding_time", ["funding_rate"])


@query(_with(_H, ("f", _FUNDING), ("j", _ASOF)) + "SELECT symbol, open_time, funding_rate FROM j")
def funding_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _funded(spark, sf_dir).select("symbol", "open_time", "funding_rate")


@query(_with(_H, ("f", _FUNDING), ("j", _ASOF), ("s", f"SELECT *, {_full('avg', 'funding_rate', 8)} AS a, {_full('avg', 'funding_rate', 24)} AS b FROM j")) + "SELECT symbol, open_time, round(a - b, 9) AS value FROM s")
def factor_funding_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compute_factor("funding_momentum", _funded(spark, sf_dir), **SERIES_TIME)
    return out.select("symbol", "open_time", F.round("value", 9).alias("value"))


@query(_rsi_sql(14))
def pandas_factor_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same index written in pandas, series by series."""

    def rsi(df):
        delta = df["close"].diff()
        gain, loss = delta.clip(lower=0).rolling(14).mean(), (-delta).clip(lower=0).rolling(14).mean()
        return (100 - 100 / (1 + gain / loss.where(loss > 1e-12))).where(loss > 1e-12, (gain > 1e-12).map({True: 100.0, False: None}).astype(float))

    return rounded(pandas_factor(rsi, bars.hourly_bars(spark, sf_dir), ("symbol",), "open_time"), "value")


# ---- evaluation


@query(_with(_D) + f"SELECT symbol, open_time, round(fwd_ret, 6) AS fwd_ret FROM (SELECT *, {_FWD} FROM d)")
def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.forward_returns(bars.daily_bars(spark, sf_dir), "1 DAY").select("symbol", "open_time", "fwd_ret"), "fwd_ret")


@query(_with(_D, _P, ("r", _ranks("p", "value", "fwd_ret", "open_time")), ("i", _IC)) + "SELECT open_time, round(ic, 6) AS ic, n FROM i")
def rank_ic_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.ic_series(_panel(spark, sf_dir)), "ic")


@query(_with(_D, _P, ("r", "SELECT open_time, value AS x, fwd_ret AS y FROM p WHERE value IS NOT NULL AND fwd_ret IS NOT NULL"), ("i", _IC)) + "SELECT open_time, round(ic, 6) AS ic, n FROM i")
def pearson_ic_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.ic_series(_panel(spark, sf_dir), method="pearson"), "ic")


@query(_with(_D, ("p", f"SELECT *, 1 AS one FROM ({PANEL})"), ("r", _ranks("p", "value", "fwd_ret", "one"))) + f"SELECT round({_corr('x', 'y')}, 6) AS ic, count(*) AS n FROM r")
def rank_ic_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.pooled_rank_ic(_panel(spark, sf_dir)), "ic")


_LONG_IC = (_D, ("w", _WIDE), ("p", _UNPIVOT), ("r", _ranks("p", "value", "fwd_ret", "factor_name, open_time")), ("i", f"SELECT factor_name, open_time, {_corr('x', 'y')} AS ic FROM r GROUP BY factor_name, open_time HAVING count(*) >= 2"))
_SUMMARY = "SELECT factor_name, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, count(*) AS n_periods FROM i WHERE ic IS NOT NULL GROUP BY factor_name"


@query(_with(*_LONG_IC, ("s", _SUMMARY)) + "SELECT factor_name, round(ic_mean, 6) AS ic_mean, round(ic_std, 6) AS ic_std, round(icir, 6) AS icir, round(win_rate, 6) AS win_rate, n_periods FROM s")
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.ic_summary(_long(spark, sf_dir)), "ic_mean", "ic_std", "icir", "win_rate")


@query(_with(*_LONG_IC, ("s", _SUMMARY)) + "SELECT factor_name, round(ic_mean, 6) AS ic_mean, n_periods FROM s ORDER BY abs(s.ic_mean) DESC, factor_name LIMIT 2")
def ic_ranking_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.ranked_factors(evaluate.ic_summary(_long(spark, sf_dir)), 2).select("factor_name", "ic_mean", "n_periods"), "ic_mean")


def _decay_sql(max_lag: int) -> str:
    lags = " UNION ALL ".join(f"SELECT p.open_time, p.value, {k} AS lag, q.close / p.close - 1 AS r FROM p JOIN d q ON q.symbol = p.symbol AND q.open_time = p.open_time + INTERVAL {k} DAY" for k in range(1, max_lag + 1))
    ic = f"SELECT lag, open_time, {_corr('x', 'y')} AS ic FROM r GROUP BY lag, open_time HAVING count(*) >= 2"
    return _with(_D, _P, ("l", lags), ("r", _ranks("l", "value", "r", "lag, open_time")), ("i", ic)) + "SELECT lag, round(avg(ic), 6) AS ic_mean, count(*) AS n_periods FROM i WHERE ic IS NOT NULL GROUP BY lag"


@query(_decay_sql(10))
def ic_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.ic_decay(_panel(spark, sf_dir), "1 DAY", 10), "ic_mean")


@query(_with(_D, _P, ("g", _GROUPED)) + "SELECT CAST(bucket AS INTEGER) AS bucket, round(avg(fwd_ret), 6) AS mean_ret, count(*) AS n FROM g GROUP BY bucket")
def grouping_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.grouping_backtest(_panel(spark, sf_dir)), "mean_ret")


@query(_with(_D, _P, ("g", _GROUPED), ("ls", _LS)) + "SELECT open_time, round(gross, 6) AS gross FROM ls WHERE gross IS NOT NULL")
def long_short_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.long_short_returns(_panel(spark, sf_dir)), "gross")


def _pairs_sql(select: str) -> str:
    from itertools import combinations

    return " UNION ALL ".join(select.format(a=a, b=b) for a, b in combinations(sorted(FACTORS), 2))


_MATRIX = _pairs_sql("SELECT '{a}' AS factor_a, '{b}' AS factor_b, " + _corr("{a}", "{b}") + " AS rho FROM w WHERE {a} IS NOT NULL AND {b} IS NOT NULL")


@query(_with(_D, ("w", _WIDE), ("m", _MATRIX)) + "SELECT factor_a, factor_b, round(rho, 6) AS rho FROM m")
def factor_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.correlation_matrix(_wide(spark, sf_dir), list(FACTORS)), "rho")


_RANKED_PAIRS = _pairs_sql("SELECT '{a}' AS factor_a, '{b}' AS factor_b, open_time, {a} AS u, {b} AS v FROM w")


@query(_with(_D, ("w", _WIDE), ("l", _RANKED_PAIRS), ("r", _ranks("l", "u", "v", "factor_a, factor_b, open_time")), ("i", f"SELECT factor_a, factor_b, open_time, {_corr('x', 'y')} AS rho FROM r GROUP BY factor_a, factor_b, open_time")) + "SELECT factor_a, factor_b, round(avg(rho), 6) AS rho FROM i GROUP BY factor_a, factor_b")
def factor_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.correlation_matrix(_wide(spark, sf_dir), list(FACTORS), "spearman", ("open_time",)), "rho")


_POOLED_PAIRS = _pairs_sql("SELECT '{a}' AS factor_a, '{b}' AS factor_b, {a} AS u, {b} AS v FROM w")


@query(_with(_D, ("w", _WIDE), ("l", _POOLED_PAIRS), ("r", _ranks("l", "u", "v", "factor_a, factor_b"))) + f"SELECT factor_a, factor_b, round({_corr('x', 'y')}, 6) AS rho FROM r GROUP BY factor_a, factor_b")
def factor_rank_correlation_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations over all rows together."""
    return rounded(evaluate.correlation_matrix(_wide(spark, sf_dir), list(FACTORS), "spearman"), "rho")


_DOUBLED = f"SELECT *, 3 * momentum_1 + CASE WHEN symbol < '5' THEN sma_dev_3 ELSE 0 END AS momentum_copy FROM ({_WIDE})"


def _double_pairs(select: str) -> str:
    from itertools import combinations

    return " UNION ALL ".join(select.format(a=a, b=b) for a, b in combinations(sorted([*FACTORS, "momentum_copy"]), 2))


_DOUBLE_MATRIX = _double_pairs("SELECT '{a}' AS factor_a, '{b}' AS factor_b, " + _corr("{a}", "{b}") + " AS rho FROM w WHERE {a} IS NOT NULL AND {b} IS NOT NULL")


@query(_with(_D, ("w", _DOUBLED), ("m", _DOUBLE_MATRIX)) + "SELECT factor_a, factor_b, round(rho, 6) AS rho FROM m WHERE abs(rho) > CAST(0.5 AS DOUBLE)")
def redundant_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one factor more that follows another closely."""
    copy = 3 * F.col("momentum_1") + F.when(F.col("symbol") < "5", F.col("sma_dev_3")).otherwise(0.0)
    wide = _wide(spark, sf_dir).withColumn("momentum_copy", copy)
    return rounded(evaluate.redundant_factors(evaluate.correlation_matrix(wide, [*FACTORS, "momentum_copy"]), 0.5), "rho")


_SHARES = "SELECT factor_name, open_time, symbol, (rank() OVER (PARTITION BY factor_name, open_time ORDER BY value) + (count(*) OVER (PARTITION BY factor_name, open_time, value) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER (PARTITION BY factor_name, open_time) AS share, ntile(5) OVER (PARTITION BY factor_name, open_time ORDER BY value, symbol) AS bucket FROM p WHERE value IS NOT NULL"
_LAGGED = "SELECT *, lag(share) OVER (PARTITION BY factor_name, symbol ORDER BY open_time) AS share0, lag(bucket) OVER (PARTITION BY factor_name, symbol ORDER BY open_time) AS bucket0 FROM s"


@query(_with(_D, ("w", _WIDE), ("p", _UNPIVOT), ("s", _SHARES), ("m", _LAGGED)) + f"SELECT factor_name, round(avg(abs(share - share0)), 6) AS mean_rank_change, round({_corr('share', 'share0')}, 6) AS rank_autocorr, round(avg(CASE WHEN bucket <> bucket0 THEN 1.0 ELSE 0.0 END), 6) AS bucket_change_rate, count(*) AS n FROM m WHERE share0 IS NOT NULL GROUP BY factor_name")
def turnover_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.turnover_analysis(_long(spark, sf_dir)), "mean_rank_change", "rank_autocorr", "bucket_change_rate")


@query(_with(*_COST) + "SELECT open_time, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(gross - turnover * CAST(0.0015 AS DOUBLE), 6) AS net FROM ls JOIN turn USING (open_time) WHERE gross IS NOT NULL")
def cost_adjusted_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.cost_adjusted_returns(_panel(spark, sf_dir)), "gross", "turnover", "net")


@query(_with(*_COST) + "SELECT round(avg(gross) / nullif(avg(turnover), 0), 6) AS breakeven_cost, count(*) AS n_periods FROM ls JOIN turn USING (open_time) WHERE gross IS NOT NULL")
def breakeven_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.breakeven_cost(_panel(spark, sf_dir)), "breakeven_cost")


@query(_with(_D, _P) + "SELECT CAST(CASE WHEN value < -1 THEN 0 WHEN value >= 1 THEN 21 ELSE floor((value + 1) / 2 * 20) + 1 END AS INTEGER) AS bin, count(*) AS n FROM p WHERE value IS NOT NULL GROUP BY 1")
def factor_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram(_panel(spark, sf_dir), -1.0, 1.0, 20)


# ---- look-ahead


_SPOILT_TIMES = """SELECT symbol, CASE WHEN num_trades % 5 = 0 THEN open_time + INTERVAL 1 HOUR ELSE open_time END AS t FROM d
 UNION ALL SELECT symbol, open_time FROM d WHERE num_trades % 4 = 1"""


@query(
    _with(_D, ("f", _SPOILT_TIMES), ("c", "SELECT symbol, t, count(*) AS n FROM f GROUP BY symbol, t"))
    + "SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicate, CAST(sum(CASE WHEN d.symbol IS NULL THEN n ELSE 0 END) AS BIGINT) AS n_unmatched FROM c LEFT JOIN d ON d.symbol = c.symbol AND d.open_time = c.t"
)
def forward_check_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor values of which some stand at times without a bar and some twice."""
    p, n = _panel(spark, sf_dir), F.col("num_trades")
    moved = p.withColumn("open_time", F.when(n % 5 == 0, F.expr("open_time + INTERVAL 1 HOUR")).otherwise(F.col("open_time")))
    return forward_check.timestamp_alignment(moved.unionByName(p.where(n % 4 == 1)), bars.daily_bars(spark, sf_dir), "open_time", ("symbol",))


_FIXED = _with(_D, ("p", f"SELECT *, {_FWD} FROM d"))


@query(_FIXED + "SELECT count(*) AS n_rows, CAST(sum(CASE WHEN fwd_ret IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unmatched, CAST(0 AS BIGINT) AS n_misaligned FROM p")
def forward_check_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values known at a bar's close against returns from the next bar's open on."""
    p = evaluate.forward_returns(bars.daily_bars(spark, sf_dir), "1 DAY")
    values = p.select("symbol", "open_time", F.col("close_time").alias("available_at"))
    returns = p.where(F.col("fwd_ret").isNotNull()).select("symbol", "open_time", F.col("close_time").alias("ret_start"), F.expr("close_time + INTERVAL 1 DAY").alias("ret_end"))
    return forward_check.forward_return_alignment(values, returns, ("symbol", "open_time"))


@query(_FIXED + """SELECT count(*) AS n_rows, CAST(sum(CASE WHEN fwd_ret IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unmatched,
 CAST(sum(CASE WHEN fwd_ret IS NOT NULL AND (num_trades % 3 = 0 OR num_trades % 4 = 0) THEN 1 ELSE 0 END) AS BIGINT) AS n_misaligned FROM p""")
def forward_check_misaligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of which some begin before the value is known and some end where they begin."""
    p, n = evaluate.forward_returns(bars.daily_bars(spark, sf_dir), "1 DAY"), F.col("num_trades")
    values = p.select("symbol", "open_time", F.col("close_time").alias("available_at"))
    start = F.when(n % 3 == 0, F.expr("close_time - INTERVAL 1 HOUR")).otherwise(F.col("close_time"))
    end = F.when((n % 4 == 0) & (n % 3 != 0), F.col("close_time")).otherwise(F.expr("close_time + INTERVAL 1 DAY"))
    returns = p.where(F.col("fwd_ret").isNotNull()).select("symbol", "open_time", start.alias("ret_start"), end.alias("ret_end"))
    return forward_check.forward_return_alignment(values, returns, ("symbol", "open_time"))


@query(_with(_H, ("c", "SELECT DISTINCT open_time FROM h ORDER BY open_time LIMIT 3 OFFSET 30")) + "SELECT h.open_time AS cut, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_mismatch FROM h JOIN c USING (open_time) GROUP BY 1")
def forward_check_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered factor with its default parameters: taking later rows away changes nothing.

    The three cuts of the SQL are given always; five cuts spread over all hours, the last included, where a factor mismatches.
    """
    hourly = _funded(spark, sf_dir)
    hours = [r[0] for r in hourly.select("open_time").distinct().orderBy("open_time").collect()]
    named, names = hours[30:33], list_factors()
    spread = [hours[-(-len(hours) * i // 5) - 1] for i in range(1, 6)] if hours else []
    compute = lambda df: compute_factors(df, {f: (f, None) for f in names}, **SERIES_TIME)
    found = forward_check.prefix_mismatches(compute, hourly, sorted({*named, *spread}), "open_time", ("symbol",), names)
    return found.where(F.col("cut").isin(named) | (F.col("n_mismatch") > 0)) if named else found.where(F.col("n_mismatch") > 0)


# ---- layers, files and streams


def _temporary(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in the one for checkpoints, or a local one where all runs on this machine."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


_SILVER_SQL = _with(_H) + "SELECT open_time AS open_time_utc, close_time AS close_time_utc, open, high, low, close, volume, quote_volume, taker_buy_volume, taker_buy_quote_volume, num_trades, upper(symbol) AS symbol, \"interval\" FROM h"


@query(_SILVER_SQL)
def medallion_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze written, read, checked, cleaned, written as Silver and read again."""
    root = _temporary(spark)
    files.write_bronze_klines(_bronze(spark, sf_dir), f"{root}/bronze")
    return _naive(files.build_silver(spark, f"{root}/bronze", f"{root}/silver", ("symbol", "interval")).select(*SILVER_COLUMNS), "open_time_utc", "close_time_utc")


@query("SELECT * FROM (VALUES ('momentum'), ('sma_dev')) t(factor_name)")
def gold_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, silver = Lake(_temporary(spark)), bars.as_silver(bars.hourly_bars(spark, sf_dir))
    for name in ("sma_dev", "momentum"):
        files.write_gold_factor(compute_factor(name, silver), lake, factor_name=name, exchange="replay")
    return spark.createDataFrame([(n,) for n in files.list_gold_factors(spark, lake)], "factor_name string")


@query(_FACTOR_SQL["momentum"][2])
def gold_factor_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, silver = Lake(_temporary(spark)), bars.as_silver(bars.hourly_bars(spark, sf_dir))
    files.write_gold_factor(compute_factor("momentum", silver), lake, factor_name="momentum", exchange="replay")
    out = files.read_gold_factor(spark, lake, factor_name="momentum")
    return rounded(_naive(out.select("symbol", F.col("open_time_utc").alias("open_time"), "value"), "open_time"), "value")


@query(_with(_D) + "SELECT symbol, open_time, close, num_trades FROM d")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _temporary(spark)
    files.write_csv(bars.daily_bars(spark, sf_dir).select("symbol", "open_time", "close", "num_trades"), path)
    return files.read_csv(spark, path, "symbol string, open_time timestamp_ntz, close double, num_trades bigint")


@query(_with(_H) + "SELECT symbol, open_time, open, high, low, close, volume, num_trades FROM h")
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles by a stream over the table, in complete mode."""
    path = f"{sf_dir}/events.parquet"
    # a stream reads folders: of a table that is one file, the folder with this file's name alone
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parque*")
    root = _temporary(spark)
    candles = streaming.stream_bars(source, "1 hour", "ts", "value", "value", "event_type")
    return _naive(streaming.run_available(candles, f"{root}/bars", f"{root}/checkpoint"), "open_time")


@query("""SELECT rule, count(*) AS n FROM (SELECT CASE WHEN event_id % 11 = 0 THEN 'time with zone' WHEN value <= 0 OR event_id % 7 = 0 THEN 'price over 0'
 WHEN event_id % 5 = 0 THEN 'side is buy or sell' ELSE 'none' END AS rule FROM events) GROUP BY rule""")
def trade_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades as JSON messages, some of them spoilt: how many break which rule first."""
    e, k = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    at = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.when(k % 11 == 0, "").otherwise("Z"))
    message = F.struct(at.alias("timestamp"), F.when(k % 7 == 0, -1.0).otherwise(F.col("value")).cast("string").alias("price"), F.lit("1").alias("quantity"), F.when(k % 5 == 0, "hold").otherwise("buy").alias("side"), F.lit("BTC").alias("symbol"))
    rows = ingest.parse_trades(e.select(F.to_json(message).alias("value")))
    return rows.groupBy(F.coalesce("broken", F.lit("none")).alias("rule")).agg(F.count("*").alias("n"))


@query("SELECT event_id, round(value - 500, 4) AS funding_rate, make_timestamp(epoch_us(ts) // 1000 * 1000) AS at FROM events WHERE event_id % 13 <> 0")
def funding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding messages with an offset of eight hours, and some without any, which are left out."""
    e, k = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    ahead = F.date_format(F.col("ts").cast("timestamp") + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    message = F.struct(F.concat(ahead, F.when(k % 13 == 0, "").otherwise("+08:00")).alias("timestamp"), F.round(F.col("value") - 500, 4).cast("string").alias("funding_rate"), k.cast("string").alias("symbol"))
    rows = ingest.parse_funding(e.select(F.to_json(message).alias("value"))).where(F.col("broken").isNull())
    return rows.select(F.col("symbol").cast("long").alias("event_id"), "funding_rate", F.col("timestamp").cast("timestamp_ntz").alias("at"))


@query(_with(_D) + "SELECT symbol, open_time, close FROM d QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time) <= 3")
def earliest_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit of rows for each symbol, as fetches have it."""
    return replay.earliest(bars.daily_bars(spark, sf_dir), "open_time", 3).select("symbol", "open_time", "close")


# ---- time buckets and blocks


_LATE = "num_trades % 3 = 0 AND open_time >= (SELECT date_trunc('day', min(open_time)) + INTERVAL 9 DAY FROM h) AND open_time < (SELECT date_trunc('day', min(open_time)) + INTERVAL 12 DAY FROM h)"


def _placed_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.as_silver(bars.hourly_bars(spark, sf_dir)).withColumns({"exchange": F.lit("replay"), "market": F.lit("spot")})


def _named(name: str) -> str:
    return f"SELECT symbol, open_time, '{name}' AS factor_name, value FROM ({_FACTOR_SQL[name][2]})"


@query(f"{_named('momentum')} UNION ALL {_named('sma_dev')}")
def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold after bars in the middle of all series came late: the same as from all bars at once. Only the days that the late bars reach are read and written again."""
    lake, silver, names = Lake(_temporary(spark), "yyyy-MM-dd"), _placed_silver(spark, sf_dir), ["momentum", "sma_dev"]
    first = silver.agg(F.date_trunc("DAY", F.min("open_time_utc")).alias("t")).first()["t"]
    late = (F.col("num_trades") % 3 == 0) & (F.col("open_time_utc") >= F.lit(first) + F.expr("INTERVAL 9 DAYS")) & (F.col("open_time_utc") < F.lit(first) + F.expr("INTERVAL 12 DAYS"))
    for arrived in (silver.where(~late), silver.where(late)):
        refresh.merge_silver(arrived, lake)
        changed = refresh.changes(arrived)
        if not changed.isEmpty():
            refresh.refresh_gold(spark, lake, changed, names)
    rows = files.read_gold(spark, lake).select("symbol", F.col("open_time_utc").alias("open_time"), "factor_name", "value")
    return rounded(_naive(rows, "open_time"), "value")


_SPOILT_ROWS = """SELECT *, CASE WHEN num_trades % 7 = 0 THEN low - 1 ELSE high END AS h2, CASE WHEN num_trades % 3 = 0 THEN -1 ELSE num_trades END AS n2 FROM h"""


@query(
    _with(_H, ("x", _SPOILT_ROWS), ("r", """SELECT CASE WHEN least(open, h2, low, close) <= 0 THEN 'price not over 0' WHEN h2 < greatest(open, close, low) OR low > least(open, close, h2) THEN 'prices out of order'
 WHEN n2 < 0 THEN 'amount below 0' ELSE 'good' END AS rule FROM x UNION ALL SELECT 'duplicate times' FROM h WHERE num_trades % 4 = 0"""))
    + "SELECT rule, count(*) AS n FROM r GROUP BY rule"
)
def quarantined_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoilt candles merged into Silver in one checked pass: how many came there, and how many went to quarantine by which rule."""
    lake, n = Lake(_temporary(spark)), F.col("num_trades")
    silver = _placed_silver(spark, sf_dir)
    spoilt = silver.withColumn("high", F.when(n % 7 == 0, F.col("low") - 1).otherwise(F.col("high"))).withColumn("num_trades", F.when(n % 3 == 0, F.lit(-1)).otherwise(n))
    again = spoilt.withColumn("close_time_utc", F.col("close_time_utc") + F.expr("INTERVAL 1 SECOND")).join(silver.where(n % 4 == 0).select("symbol", "open_time_utc"), ["symbol", "open_time_utc"])
    refresh.merge_silver(spoilt.unionByName(again), lake, quarantine=True)
    rules = spark.read.parquet(lake.quarantine).select(F.col("broken").alias("rule")).unionByName(files.read_lake_silver(spark, lake).select(F.lit("good").alias("rule")))
    return rules.groupBy("rule").agg(F.count("*").alias("n"))


_HALF = _RANGE.replace("INTERVAL 11 DAY", "INTERVAL 6 DAY")


@query(_with(_H) + f"SELECT 'alpha' AS exchange, upper(symbol) AS symbol, open_time, close FROM h WHERE {_HALF} UNION ALL SELECT 'beta', upper(symbol), open_time, close FROM h WHERE {_RANGE}")
def replay_two_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same symbols of two exchanges downloaded into one Bronze, one of them twice: neither takes the other's candles for its own."""
    root, symbols, start, end = _recorded(spark, sf_dir)
    for exchange, until in (("alpha", start + (end - start) / 2), ("beta", end), ("beta", end)):
        replay.Downloader(spark, root, f"{root}/bronze", exchange).download_all(symbols, "1h", start, until)
    rows = files.read_lake_bronze(spark, f"{root}/bronze")
    return rows.select("exchange", "symbol", F.timestamp_millis("open_time").cast("timestamp_ntz").alias("open_time"), "close")


@query("""SELECT event_id, round(value / 1000, 6) AS funding_rate, make_timestamp(epoch_us(ts) // 1000 * 1000) AS at FROM events WHERE event_type = (SELECT max(event_type) FROM events)
 AND ts >= (SELECT date_trunc('day', min(ts)) + INTERVAL 3 DAY FROM events) AND ts < (SELECT date_trunc('day', min(ts)) + INTERVAL 8 DAY FROM events)""")
def replay_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded funding rates of one symbol, a file for each day, in a range of five days; the limit is above their number."""
    root, e = _temporary(spark), spark.read.parquet(f"{sf_dir}/events.parquet")
    most, first = e.agg(F.max("event_type"), F.date_trunc("DAY", F.min("ts"))).first()
    at = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    message = F.struct(at.alias("timestamp"), F.round(F.col("value") / 1000, 6).cast("string").alias("funding_rate"), F.col("event_id").cast("string").alias("symbol"))
    rows = e.where(F.col("event_type") == most).select(F.to_json(message).alias("value"))
    rows.write.text(f"{root}/funding/{most.upper()}")
    start = first.replace(tzinfo=timezone.utc) + timedelta(days=3)
    # each message has a symbol of its own here, so that the limit holds none back
    got = replay.ReplayClient(spark, root, most).fetch_funding_rate(start, start + timedelta(days=5))
    return got.select(F.col("symbol").cast("long").alias("event_id"), "funding_rate", F.col("timestamp").cast("timestamp_ntz").alias("at"))


_UP = "avg(CASE WHEN close > open THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
_RISING = f"SELECT symbol FROM h GROUP BY symbol HAVING {_UP} > (SELECT {_UP} FROM h)"


@query(_with(_H, ("u", _RISING)) + "SELECT DISTINCT symbol, 'momentum' AS factor_name FROM h UNION ALL SELECT symbol, 'sma_dev' FROM u")
def gold_catalog_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which factors Gold has for which symbol, from folders alone; one factor was written only for symbols that rise in more hours than all together."""
    lake, silver = Lake(_temporary(spark)), _placed_silver(spark, sf_dir)
    up = F.avg((F.col("close") > F.col("open")).cast("double")).alias("up")
    rising = silver.groupBy("symbol").agg(up).where(F.col("up") > silver.agg(up).first()["up"])
    for name, rows in (("momentum", silver), ("sma_dev", silver.join(rising, "symbol", "left_semi"))):
        files.write_gold_factor(compute_factor(name, rows), lake, factor_name=name, exchange="replay")
    found = files.partitions(spark, lake.gold, files.GOLD_PARTS[:5])
    return spark.createDataFrame([(p["symbol"], p["factor_name"]) for p in found], "symbol string, factor_name string")


@query(_with(_H, ("a", _FACTOR_SQL["sma_dev"][2]), ("b", _rsi_sql(14))) + "SELECT symbol, open_time, a.value AS sma_dev, b.value AS rsi FROM a JOIN b USING (symbol, open_time)")
def factors_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors over series that are cut into blocks of three days, with as many bars before each as the factors look back."""
    out = compute_factors_in_blocks(bars.hourly_bars(spark, sf_dir), {"sma_dev": ("sma_dev", None), "rsi": ("rsi", None)}, **SERIES_TIME, width="3 DAYS")
    return rounded(out.select("symbol", "open_time", "sma_dev", "rsi"), "sma_dev", "rsi")


@query(_factor_sql("v", ("v", _full("avg", "close", 10))))
def pandas_factor_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor in pandas that gets blocks of four days with nine bars before each."""
    return rounded(pandas_factor(lambda d: d["close"].rolling(10).mean(), bars.hourly_bars(spark, sf_dir), ("symbol",), "open_time", lookback=9, width="4 DAYS"), "value")


@query(_rsi_sql(14))
def bucketed_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor over Silver that is stored in buckets of its series: no shuffle."""
    path = _temporary(spark)
    table = f"silver_{path.rsplit('/', 1)[-1]}"
    files.save_bucketed_silver(_placed_silver(spark, sf_dir), table, 8, path)
    out = compute_factor("rsi", spark.table(table), keys=files.PLACE)
    return rounded(_naive(out.select("symbol", F.col("open_time_utc").alias("open_time"), "value"), "open_time"), "value")


@query(_with(_D, _P, ("r", _ranks("p", "value", "fwd_ret", "open_time")), ("i", _IC)) + "SELECT open_time, round(ic, 6) AS ic, n FROM i")
def spread_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank ICs by ranges of values, as cross-sections need them that are too large for one task."""
    return rounded(evaluate.ic_series(_panel(spark, sf_dir), spread=True), "ic")


@query(_with(_D, _P, ("g", _GROUPED)) + "SELECT symbol, open_time, CAST(bucket AS INTEGER) AS bucket FROM g")
def spread_ntiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile groups in the same way."""
    return evaluate.grouped(_panel(spark, sf_dir), spread=True).select("symbol", "open_time", "bucket")


_LEAKS = {
    "next_close": f"lead(close) OVER ({_W})",
    "final_close": f"last_value(close) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "hours_around": f"sum(close) OVER ({_W} RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 HOUR FOLLOWING)",
    "series_mean": "avg(close) OVER (PARTITION BY symbol)",
    "hours_before": f"sum(close) OVER ({_W} RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW)",
    "mean_of_4": f"avg(close) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
}
_AHEAD = {"next_close", "final_close", "hours_around", "series_mean", "joined_ahead"}
_LEAKY = "SELECT b.*, " + ", ".join(f"{e} AS {n}" for n, e in _LEAKS.items()) + ", (SELECT max(n.close) FROM {0} n WHERE n.symbol = b.symbol AND n.open_time = b.open_time + INTERVAL 2 HOUR) AS joined_ahead FROM {0} b"
_CUT = "(SELECT date_trunc('day', min(open_time)) + INTERVAL 15 DAY FROM h)"
_DIFFER = " UNION ALL ".join(f"SELECT '{n}' AS name, {str(n in _AHEAD).lower()} AS flagged, count(*) AS n_rows, CAST(coalesce(sum(CASE WHEN (f.{n} IS NULL) <> (p.{n} IS NULL) OR abs(f.{n} - p.{n}) > CAST(0.000000001 AS DOUBLE) * greatest(1, abs(f.{n})) THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_changed FROM f JOIN p USING (symbol, open_time)" for n in [*_LEAKS, "joined_ahead"])


@query(_with(_H, ("before", f"SELECT * FROM h WHERE open_time <= {_CUT}"), ("f", _LEAKY.format("h")), ("p", _LEAKY.format("before"))) + _DIFFER)
def forward_check_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of which five look ahead: what the walk through the plan says of each, and how many values up to a cut change when later bars are taken away."""

    def compute(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("symbol").orderBy("open_time")
        seconds = Window.partitionBy("symbol").orderBy(F.unix_seconds(F.col("open_time").cast("timestamp")))
        later = df.select("symbol", F.expr("open_time - INTERVAL 2 HOURS").alias("open_time"), F.col("close").alias("joined_ahead"))
        columns = {"next_close": F.lead("close").over(w), "final_close": F.last("close").over(w.rowsBetween(0, Window.unboundedFollowing)), "hours_around": F.sum("close").over(seconds.rangeBetween(-3600, 3600)), "series_mean": F.avg("close").over(Window.partitionBy("symbol")), "hours_before": F.sum("close").over(seconds.rangeBetween(-7200, 0)), "mean_of_4": F.avg("close").over(w.rowsBetween(-3, 0))}
        return df.withColumns(columns).join(later, ["symbol", "open_time"], "left")

    hourly, names = bars.hourly_bars(spark, sf_dir).select("symbol", "open_time", "close"), [*_LEAKS, "joined_ahead"]
    cut = hourly.agg((F.date_trunc("DAY", F.min("open_time")) + F.expr("INTERVAL 15 DAYS")).cast("timestamp_ntz").alias("t")).first()["t"]
    flagged = forward_check.looks_ahead(compute(spark.createDataFrame([], hourly.schema)), names, "open_time")
    return forward_check.changed_by_later_rows(compute, hourly, cut, names, "open_time", ("symbol",)).withColumn("flagged", F.col("name").isin(flagged))


# ---- streams that append


def _event_stream(spark: SparkSession, sf_dir: str, parts: list[DataFrame], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table that a stream appends to, which gets these parts of the events one after another, and then its end."""
    root, schema = _temporary(spark), parts[0].schema
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("ts").cast("timestamp")).first()[0]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        rows = make(streaming.with_sentinels(spark.readStream.schema(schema).parquet(f"{root}/in"), f"{root}/ends"))
        streaming.run_append(rows, f"{root}/out", f"{root}/checkpoint")
    streaming.put_sentinel(spark, schema, f"{root}/ends", ts=last + timedelta(days=400), event_id=-1, event_type="", value=1.0)
    streaming.run_append(make(streaming.with_sentinels(spark.readStream.schema(schema).parquet(f"{root}/in"), f"{root}/ends")), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


def _timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")


@query("SELECT event_id, event_type, value FROM events")
def stream_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which many come twice, in the same batch or in the next: each is given once."""
    e = _timed_events(spark, sf_dir)
    parts = [e.unionByName(e.where(F.col("event_id") % 5 == 0)), e.where(F.col("event_id") % 3 == 0)]
    rows = _event_stream(spark, sf_dir, parts, lambda s: streaming.distinct_rows(s, ["event_id"], "ts", "2 days"))
    return rows.where(F.col("event_id") >= 0).select("event_id", "event_type", "value")


_IN_TIME = "(event_id % 4 <> 0 OR date_trunc('hour', ts) + INTERVAL 1 HOUR > (SELECT max(ts) - INTERVAL 10 DAY FROM events WHERE event_id % 4 <> 0))"


@query(f"SELECT event_type AS symbol, date_trunc('hour', ts) AS open_time, max(value) AS high, min(value) AS low, count(*) AS num_trades FROM events WHERE value > 0 AND {_IN_TIME} GROUP BY 1, 2")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the trades come after the others: those whose window was closed meanwhile, ten days behind, are left out."""
    e = _timed_events(spark, sf_dir).where(F.col("value") > 0)
    late = F.col("event_id") % 4 == 0
    rows = _event_stream(spark, sf_dir, [e.where(~late), e.where(late)], lambda s: streaming.stream_bars(s, "1 hour", "ts", "value", "value", "event_type", "10 days"))
    return _naive(rows, "open_time").select("symbol", "open_time", "high", "low", "num_trades")


# ---- contract by order of arrival, factor input, intervals


@query(
    _with(_H, ("o", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN num_trades % 4 = 0 THEN open_time + INTERVAL 5 HOUR ELSE open_time END, open_time) AS arrived FROM h"), ("l", "SELECT *, lag(open_time) OVER (PARTITION BY symbol ORDER BY arrived) AS before FROM o"))
    + "SELECT count(*) AS n_rows, CAST(sum(CASE WHEN open_time < before THEN 1 ELSE 0 END) AS BIGINT) AS n_late FROM l"
)
def klines_by_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles of which some arrive five hours late: how many times fall along the order of arrival."""
    silver, n = bars.as_silver(bars.hourly_bars(spark, sf_dir)), F.col("num_trades")
    moved = F.when(n % 4 == 0, F.expr("open_time_utc + INTERVAL 5 HOURS")).otherwise(F.col("open_time_utc"))
    ordered = silver.withColumn("arrived", F.row_number().over(Window.partitionBy("symbol").orderBy(moved, "open_time_utc")))
    return validate.violations(ordered, ordinal="arrived").select(F.col("rows").alias("n_rows"), F.col("`times out of order`").alias("n_late"))


@query(_with(_D) + "SELECT upper(symbol) AS symbol, open_time, close_time AS available_at, close FROM d")
def factor_input_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked candles with the time from which they are known."""
    silver = bars.as_silver(bars.daily_bars(spark, sf_dir)).withColumn("symbol", F.upper("symbol"))
    return _naive(medallion.factor_input(silver).select("symbol", F.col("open_time_utc").alias("open_time"), "available_at", "close"), "open_time", "available_at")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 60000 WHEN 1 THEN 900000 WHEN 2 THEN 86400000 WHEN 3 THEN NULL ELSE NULL END AS ms FROM events""")
def interval_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of named intervals; months and unknown names have none."""
    k = F.col("event_id") % 5
    name = F.when(k == 0, "1m").when(k == 1, "15m").when(k == 2, "1d").when(k == 3, "1M").otherwise("7m")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", interval_ms_column(name).cast("int").alias("ms"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
