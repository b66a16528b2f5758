"""Ingest, contract, quality, layers, identifiers and times."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barlight.functions.identifiers import inside, is_safe_segment, segment
from barlight.functions.intervals import INTERVAL_MS, canonical_interval, interval_ms, interval_ms_column
from barlight.functions.timeutil import now_utc, to_unix_ms, to_utc, unix_ms_column, utc_column
from barlight.operators import bars, ingest, medallion, quality
from barlight.operators.schemas import BRONZE_KLINE, SILVER_COLUMNS, SILVER_KLINE
from barlight.operators.validate import ContractError, has_columns, validate_klines
from barlight.sources import files, layout
from barlight.sources.layout import Lake

WIRE = [0, "1.0", "2.0", "0.5", "1.5", "10.0", 59999, "15.0", 3, "5.0", "7.0", "0"]
T0 = datetime(2024, 1, 1, tzinfo=UTC)


def wire(spark, *messages):
    return ingest.parse_wire_klines(spark.createDataFrame([(json.dumps(m),) for m in messages], "value string"), "btcusdt", "1H")


def silver(spark, hours, **spoil):
    rows = []
    for i, h in enumerate(hours):
        t = T0 + timedelta(hours=h)
        row = {"open_time_utc": t, "close_time_utc": t + timedelta(hours=1) - timedelta(milliseconds=1), "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 10.0, "quote_volume": 15.0, "taker_buy_volume": 5.0, "taker_buy_quote_volume": 7.0, "num_trades": 3, "symbol": "BTC", "interval": "1h"}
        if i == 1:
            row |= spoil
        rows.append(tuple(row[c] for c in SILVER_COLUMNS))
    return spark.createDataFrame(rows, SILVER_KLINE)


# ---- messages


def test_wire_row_becomes_bronze(spark):
    r = ingest.strict(wire(spark, WIRE)).first()
    assert (r.open_time, r.high, r.number_of_trades, r.symbol, r.interval) == (0, 2.0, 3, "BTCUSDT", "1h")


@pytest.mark.parametrize(
    ("message", "rule"),
    [
        (WIRE[:11], "twelve elements"),
        ([*WIRE[:2], "0.25", *WIRE[3:]], "high is highest"),
        ([*WIRE[:3], "1.7", *WIRE[4:]], "low is lowest"),
        ([*WIRE[:1], "0", *WIRE[2:]], "open over 0"),
        ([*WIRE[:4], "NaN", *WIRE[5:]], "close over 0"),
        ([*WIRE[:8], 2.5, *WIRE[9:]], "number_of_trades at least 0"),
        ([*WIRE[:5], "-1", *WIRE[6:]], "volume at least 0"),
        ([70000, *WIRE[1:]], "close time after open time"),
        ([-1, *WIRE[1:]], "times at least 0"),
    ],
)
def test_broken_wire_rows_name_their_rule(spark, message, rule):
    df = wire(spark, message, WIRE)
    assert {r.broken for r in df.collect()} == {rule, None}
    with pytest.raises(ingest.InvalidRecords) as e:
        ingest.strict(df)
    assert e.value.counts == {rule: 1}


def test_infinite_prices_pass(spark):
    assert wire(spark, [*WIRE[:2], "Infinity", *WIRE[3:]]).first().broken is None


def test_trades(spark):
    good = {"timestamp": "2024-01-01T08:00:00+08:00", "price": "1", "quantity": 1, "side": "buy", "symbol": "BTCUSDT"}
    spoilt = [({"timestamp": "2024-01-01T00:00:00"}, "time with zone"), ({"price": 0}, "price over 0"), ({"quantity": -1}, "quantity over 0"), ({"side": "hold"}, "side is buy or sell"), ({"symbol": ""}, "symbol"), ({"more": 1}, "no other fields")]
    df = spark.createDataFrame([(json.dumps(good),), *((json.dumps(good | s),) for s, _ in spoilt)], "value string")
    rows = ingest.parse_trades(df).collect()
    assert [r.broken for r in rows] == [None, *(rule for _, rule in spoilt)]
    assert unix(rows[0].timestamp) == unix(T0)


def test_funding(spark):
    good = {"timestamp": "2024-01-01T00:00:00Z", "funding_rate": "-0.01", "symbol": "BTC"}
    df = spark.createDataFrame([(json.dumps(good | s),) for s in ({}, {"funding_rate": "x"}, {"timestamp": "2024-01-01"})], "value string")
    assert [(r.broken, r.funding_rate) for r in ingest.parse_funding(df).collect()][0] == (None, -0.01)
    assert [r.broken for r in ingest.parse_funding(df).collect()][1:] == ["rate", "time with zone"]


def unix(t):
    return int((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp())


# ---- layers


def test_bronze_to_silver_to_factor_input(spark):
    bronze = ingest.strict(wire(spark, WIRE)).withColumns({"symbol": F.lit("btcusdt"), "interval": F.lit("1H"), "more": F.lit(1)})
    out = medallion.bronze_to_silver(bronze)
    assert tuple(out.columns) == SILVER_COLUMNS
    r = medallion.factor_input(out).first()
    assert (r.symbol, r.interval, r.available_at) == ("BTCUSDT", "1h", r.close_time_utc)


def test_bronze_lacking_columns_or_rows_is_refused(spark):
    with pytest.raises(ContractError, match="columns missing"):
        medallion.bronze_to_silver(spark.createDataFrame([(1.0,)], "open double"))
    with pytest.raises(ContractError, match="no rows"):
        medallion.bronze_to_silver(spark.createDataFrame([], BRONZE_KLINE))


def test_unsorted_bronze_is_refused_where_the_order_is_known(spark):
    bronze = ingest.strict(wire(spark, WIRE, [3600000, *WIRE[1:6], 7199999, *WIRE[7:]]))
    ordered = bronze.withColumn("n", F.col("open_time"))
    medallion.bronze_to_silver(ordered, ordinal="n")
    with pytest.raises(ContractError, match="out of order"):
        medallion.bronze_to_silver(ordered.withColumn("n", -F.col("open_time")), ordinal="n")


@pytest.mark.parametrize(
    ("spoil", "rule"),
    [
        ({"close_time_utc": T0}, "close before open time"),
        ({"open_time_utc": T0}, "duplicate times"),
        ({"open_time_utc": None}, "times out of order"),
        ({"volume": None}, "number missing"),
        ({"close": float("nan")}, "number missing"),
        ({"low": 0.0}, "price not over 0"),
        ({"high": 1.2}, "prices out of order"),
        ({"low": 1.2}, "prices out of order"),
        ({"taker_buy_volume": -1.0}, "amount below 0"),
        ({"num_trades": -1}, "amount below 0"),
        ({"symbol": ""}, "symbol or interval empty"),
        ({"interval": None}, "symbol or interval empty"),
        ({"symbol": "", "volume": None, "low": -1.0}, "number missing"),
        ({"open_time_utc": T0, "volume": -1.0}, "duplicate times"),
    ],
)
def test_contract_reports_the_first_broken_rule(spark, spoil, rule):
    with pytest.raises(ContractError) as e:
        validate_klines(silver(spark, (0, 1, 2), **spoil))
    assert e.value.rule == rule


def test_contract_of_types(spark):
    good = silver(spark, (0, 1))
    validate_klines(good)
    for spoilt, rule in [
        (good.drop("open"), "columns missing"),
        (good.limit(0), "no rows"),
        (good.withColumn("open_time_utc", F.col("open_time_utc").cast("timestamp_ntz")), "open_time_utc is not an instant"),
        (good.withColumn("open", F.col("open").cast("string")), "open is not a number"),
        (good.withColumn("num_trades", F.col("num_trades").cast("double")), "num_trades is not whole"),
    ]:
        with pytest.raises(ContractError, match=rule):
            validate_klines(spoilt)
    assert has_columns(good, ["open", "close"])
    assert not has_columns(good, ["open", "x"])


# ---- quality


def test_missing_klines(spark):
    hours = lambda df: [r.open_time_utc.hour for r in df.orderBy("open_time_utc").collect()]
    assert hours(quality.missing_klines(silver(spark, (0, 1, 3, 4)), "1h")) == [2]
    off = silver(spark, (0, 0)).withColumn("open_time_utc", F.when(F.monotonically_increasing_id() % 2 == 0, F.col("open_time_utc")).otherwise(F.lit(T0 + timedelta(hours=2, minutes=10))))
    off = spark.createDataFrame([(T0, "A", "1h"), (T0 + timedelta(hours=2, minutes=10), "A", "1h")], "open_time_utc timestamp, symbol string, interval string")
    assert hours(quality.missing_klines(off, "1h")) == [1, 2]
    assert quality.missing_klines(silver(spark, (0,)), "1h").count() == 0
    for name in ("1M", "7m"):
        with pytest.raises(ValueError):
            quality.missing_klines(off, name)
    months = spark.createDataFrame([(T0, "A", "1M"), (datetime(2024, 4, 1, tzinfo=UTC), "A", "1M")], off.schema)
    assert quality.missing_klines(months, "1M", months=True).count() == 2


@pytest.mark.parametrize(("values", "n"), [([1.0] * 26 + [9.0], 1), ([1.0] * 25 + [9.0], 0), ([2.0] * 5, 0), ([1.0], 0), ([1.0] * 30 + [None, 99.0], 1), ([1.0] * 30 + [float("inf")], 0), (["1"] * 30 + ["x", "99"], 1)])
def test_outliers(spark, values, n):
    df = spark.createDataFrame([(v,) for v in values], "x string" if isinstance(values[0], str) else "x double")
    out = quality.outlier_mask(df, "x")
    assert out.where("is_outlier").count() == n
    assert out.where("is_outlier is null").count() == 0


def test_outlier_arguments(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        quality.outlier_mask(df, "x")
    with pytest.raises(ValueError):
        quality.outlier_mask(df, "id", 0)


# ---- files


def test_layers_on_disk(spark, tmp_path):
    bronze = ingest.strict(wire(spark, WIRE))
    files.write_bronze_klines(bronze, f"{tmp_path}/b")
    out = files.build_silver(spark, f"{tmp_path}/b", f"{tmp_path}/s", ("symbol", "interval"))
    assert out.count() == files.read_silver_klines(spark, f"{tmp_path}/s").count() == 1
    for read in (files.read_bronze_klines, files.read_silver_klines):
        with pytest.raises(FileNotFoundError):
            read(spark, f"{tmp_path}/none")


def test_gold(spark, tmp_path):
    lake = Lake(str(tmp_path))
    assert files.list_gold_factors(spark, lake) == []
    assert files.read_gold_factor(spark, lake, factor_name="rsi") is None
    rows = spark.createDataFrame([(T0, 1.0, "007", "1h"), (T0, 2.0, "1000", "1h")], "open_time_utc timestamp, value double, symbol string, interval string")
    files.write_gold_factor(rows, lake, factor_name="rsi", exchange="x")
    files.write_gold_factor(rows.withColumn("value", F.col("value") * 10), lake, factor_name="rsi", exchange="x", params={"window": 7})
    files.write_gold_factor(rows, lake, factor_name="Beta", exchange="x")
    assert files.list_gold_factors(spark, lake) == ["Beta", "rsi"]
    assert files.list_gold_factors(spark, lake, symbol="none") == []
    one = files.read_gold_factor(spark, lake, factor_name="rsi", symbol="007")
    assert [(r.symbol, r.value) for r in one.collect()] == [("007", 1.0)]
    assert sorted(r.value for r in files.read_gold_factor(spark, lake, factor_name="rsi", params={"window": 7}).collect()) == [10.0, 20.0]
    assert files.read_gold_factor(spark, lake, factor_name="none") is None


def test_csv_json_and_nanoseconds(spark, tmp_path):
    import pandas as pd

    df = spark.createDataFrame([("é", 1.5)], "a string, b double")
    files.write_csv(df, f"{tmp_path}/c", single=True)
    assert files.read_csv(spark, f"{tmp_path}/c", df.schema).collect() == df.collect()
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, f"{tmp_path}/none", "a string").count()
    files.write_json_document({"é": T0}, tmp_path / "d" / "x.json")
    assert files.read_json_document(tmp_path / "d" / "x.json") == {"é": str(T0)}
    assert "é" in (tmp_path / "d" / "x.json").read_text(encoding="utf-8")
    pd.DataFrame({"t": pd.to_datetime([1_500], unit="ms").astype("datetime64[ns]")}).to_parquet(tmp_path / "n.parquet")
    assert files.import_nanosecond_parquet(spark, str(tmp_path / "n.parquet"), ["t"]).select(F.unix_millis("t")).first()[0] == 1500


# ---- identifiers, intervals, times


def test_paths(tmp_path):
    p = layout.bronze_klines_path(tmp_path, exchange="BINANCE", market="SPOT", symbol="btcusdt", interval="1H")
    assert p == tmp_path / "bronze/binance/spot/BTCUSDT/1h/klines.parquet"
    minute, month = (layout.silver_klines_path(tmp_path, exchange="x", symbol="a", interval=i) for i in ("1m", "1M"))
    assert minute != month
    assert layout.gold_factor_path(tmp_path, exchange="x", symbol="a", interval="1h", factor_name="MyRSI").name == "MyRSI.parquet"
    assert layout.bronze_klines_path(tmp_path, exchange="x", symbol="a", interval="1h", file_format=".JSON").suffix == ".json"
    for bad in ({"exchange": "../../escape"}, {"symbol": "a/b"}, {"symbol": " a"}, {"symbol": ""}, {"interval": "a\nb"}, {"file_format": "csv"}):
        with pytest.raises(ValueError):
            layout.bronze_klines_path(tmp_path, **({"exchange": "x", "symbol": "a", "interval": "1h"} | bad))
    with pytest.raises(ValueError):
        layout.gold_factor_path(tmp_path, exchange="x", symbol="a", interval="1h", factor_name="../../escape")
    with pytest.raises(TypeError):
        segment(3, field="x")
    with pytest.raises(ValueError):
        inside(tmp_path, "..", "x")


def test_safe_segment_column_agrees_with_the_function(spark):
    names = ["a", "", " a", "a ", ".", "..", "a/b", "a\\b", "a|b", "a?b", "a*b", 'a"b', "a:b", "a<b", "a\x00b", "a\x1fb", "é", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("ok", is_safe_segment(F.col("n")))

    def safe(n):
        try:
            return bool(segment(n, field="n"))
        except (TypeError, ValueError):
            return False

    assert {r.n: r.ok for r in df.collect()} == {n: safe(n) for n in names}


def test_intervals(spark):
    assert len(INTERVAL_MS) == 14
    for name, ms in INTERVAL_MS.items():
        assert interval_ms(name) == ms
    assert (canonical_interval("1H"), canonical_interval("1M")) == ("1h", "1M")
    for bad in ("1M", "7m"):
        with pytest.raises(ValueError):
            interval_ms(bad)
    df = spark.createDataFrame([("1h",), ("1M",)], "i string")
    assert [r[0] for r in df.select(interval_ms_column(F.col("i"))).collect()] == [3_600_000, None]


def test_times(spark):
    with pytest.raises(ValueError):
        to_utc(946684800000)
    assert to_utc(946684800000, numeric_unit="ms") == to_utc(946684800, numeric_unit="s") == datetime(2000, 1, 1, tzinfo=UTC)
    assert to_utc("2026-01-01T08:00:00+08:00") == to_utc("2026-01-01") == to_utc(datetime(2026, 1, 1)) == datetime(2026, 1, 1, tzinfo=UTC)
    with pytest.raises(TypeError):
        to_utc([])
    assert now_utc().tzinfo is UTC
    import random

    rng = random.Random(1)
    ms = [rng.randrange(-(10**12), 4 * 10**12) for _ in range(500)]
    assert [to_unix_ms(to_utc(m, numeric_unit="ms")) for m in ms] == ms
    df = spark.createDataFrame([(m,) for m in ms], "m long")
    assert [r[0] for r in df.select(unix_ms_column(utc_column(F.col("m"), "ms"))).collect()] == ms


def test_bars_against_pandas(spark, sf):
    got = bars.hourly_bars(spark, sf).toPandas().set_index(["symbol", "open_time"]).sort_index()
    e = spark.read.parquet(f"{sf}/events.parquet").toPandas().query("value > 0").sort_values("ts")
    want = e.groupby(["event_type", e.ts.dt.floor("h")]).value.agg(["first", "max", "min", "last", "sum", "count"])
    assert len(got) == len(want)
    assert (got[["open", "high", "low", "close", "num_trades"]].to_numpy() == want[["first", "max", "min", "last", "count"]].to_numpy()).all()
