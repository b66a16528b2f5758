"""The data source of recorded messages, append streams whose state falls, and Silver that is read without a shuffle."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

import barlight.factors  # noqa: F401
from barlight.operators import ingest, registry
from barlight.sources import files, recorded
from barlight.sources.replay import ReplayClient
from barlight.streaming import bars as streaming

from .test_refresh import days

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def kline(h):
    ms = int((T0 + timedelta(hours=h)).timestamp() * 1000)
    return json.dumps([ms, "1", "2", "0.5", "1.5", "5", ms + 3_599_999, "7", 3, "2", "3", "0"])


def trade(h, **more):
    return json.dumps({"timestamp": (T0 + timedelta(hours=h)).isoformat(), "price": "1", "quantity": h + 1, "side": "buy", "symbol": "AAA"} | more)


def funding(h, **more):
    return json.dumps({"timestamp": (T0 + timedelta(hours=h)).isoformat(), "funding_rate": h / 100, "symbol": "AAA"} | more)


@pytest.fixture
def recordings(tmp_path):
    """Four days of messages, a file a day, and one whose name tells nothing."""
    for kind, make in (("klines/AAA/1h", kline), ("trades/AAA", trade), ("funding/AAA", funding)):
        folder = tmp_path / kind
        folder.mkdir(parents=True)
        for d in range(4):
            (folder / f"{(T0 + timedelta(days=d)):%Y-%m-%d}.json").write_text("\n".join(make(24 * d + h) for h in range(24)) + "\n")
        (folder / "more.json").write_text(make(96))
        (folder / "_notes").write_text("no message")
    return tmp_path


def spoil(recordings, day):
    """Files that can't be decoded: reading one fails."""
    for kind in ("klines/AAA/1h", "trades/AAA", "funding/AAA"):
        (recordings / kind / f"2024-01-0{day}.json").write_bytes(b"\xff\xfe\xff\n")


def test_all_three_kinds(spark, recordings):
    client = ReplayClient(spark, str(recordings), "aaa")
    for root in (str(recordings), f"file:{recordings}", f"file://{recordings}"):
        recorded.register(spark)
        rows = spark.read.format("recorded").options(root=root, kind="klines", symbol="aaa", interval="1H").load()
        assert rows.count() == 97 and rows.where("at is null").count() == 0
    start, end = T0 + timedelta(hours=20), T0 + timedelta(hours=60)
    assert client.fetch_klines("1h", start, end).count() == 40
    assert client.fetch_trades(start, end).agg(F.min("quantity"), F.max("quantity"), F.count("*")).first() == (21.0, 60.0, 40)
    assert client.fetch_funding_rate(start, end, limit=7).agg(F.max("funding_rate"), F.count("*")).first() == (0.26, 7)


def test_files_out_of_range_are_not_opened(spark, recordings):
    spoil(recordings, 1)
    spoil(recordings, 4)
    client = ReplayClient(spark, str(recordings), "AAA")
    start, end = T0 + timedelta(days=1), T0 + timedelta(days=3)
    assert [client.fetch_klines("1h", start, end).count(), client.fetch_trades(start, end).count(), client.fetch_funding_rate(start, end).count()] == [48] * 3
    with pytest.raises(Exception, match="decode"):
        client.fetch_trades(T0, end).count()


def test_filters_choose_files():
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual, StringContains

    def near(*filters):
        r = recorded.RecordedReader({"root": "/x", "kind": "trades", "symbol": "a"})
        assert list(r.pushFilters(list(filters))) == list(filters)
        return [d for d in range(1, 5) if r._near(f"2024-01-0{d}.json")], r._near("more.json")

    day = 86_400_000
    first = int(T0.timestamp() * 1000)
    assert near() == ([1, 2, 3, 4], True)
    assert near(GreaterThan(("at",), first + day - 1)) == ([2, 3, 4], True)
    assert near(LessThanOrEqual(("at",), first + day)) == ([1, 2], True)
    assert near(EqualTo(("at",), first + 2 * day)) == ([3], True)
    assert near(StringContains(("value",), "x")) == ([1, 2, 3, 4], True)
    with pytest.raises(ValueError):
        recorded.RecordedReader({"root": "/x", "kind": "books", "symbol": "a"})


def test_broken_messages_are_told(spark, recordings):
    (recordings / "trades/AAA/2024-01-02.json").write_text("\n".join([trade(30), "no json", trade(31, price=0), trade(32, timestamp="2024-01-02 08:00:00")]))
    with pytest.raises(ingest.InvalidRecords) as e:
        ReplayClient(spark, str(recordings), "AAA").fetch_trades(T0 + timedelta(days=1), T0 + timedelta(days=2))
    assert sum(e.value.counts.values()) == 3 and e.value.counts["price over 0"] == 1


# ---- streams

SCHEMA = "ts timestamp, id long, symbol string, value double"


def put(spark, folder, rows):
    spark.createDataFrame([(T0 + timedelta(minutes=m), i, s, v) for m, i, s, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def state_rows(query):
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_windows_are_given_once_and_their_state_falls(spark, tmp_path):
    source, ends, out, check = (str(tmp_path / n) for n in ("in", "ends", "out", "check"))
    put(spark, source, [(m, m, f"s{m % 5}", 1.0 + m) for m in range(600)])
    stream = lambda: streaming.stream_bars(streaming.with_sentinels(spark.readStream.schema(SCHEMA).parquet(source), ends), "1 hour", "ts", "value", "value", "symbol", "2 hours")
    held = [state_rows(streaming.run_append(stream(), out, check))]
    given = lambda: {(r.symbol, r.open_time.replace(tzinfo=UTC)): r.num_trades for r in spark.read.parquet(out).collect()}
    # the latest row is of 9:59, so that the windows up to 7:00 are closed
    assert len(given()) == 7 * 5 and held[0] == 3 * 5
    put(spark, source, [(590, 1000, "s0", 5.0), (30, 1001, "s0", 5.0), (470, 1002, "s1", 2.0)])
    held.append(state_rows(streaming.run_append(stream(), out, check)))
    assert len(given()) == 7 * 5 and held[1] == 3 * 5
    streaming.put_sentinel(spark, spark.createDataFrame([], SCHEMA).schema, ends, ts=T0 + timedelta(days=9), symbol="end", value=1.0)
    held.append(state_rows(streaming.run_append(stream(), out, check)))
    bars = given()
    assert held[2] == 1 and len(bars) == 50
    assert bars["s0", T0] == 12, "a row that came after its window was given is left out"
    assert bars["s0", T0 + timedelta(hours=9)] == 13 and bars["s1", T0 + timedelta(hours=7)] == 13
    assert spark.read.parquet(out).count() == 50


def test_repeated_rows_are_dropped_and_forgotten(spark, tmp_path):
    source, ends, out, check = (str(tmp_path / n) for n in ("in", "ends", "out", "check"))
    rows = [(m, m, "s", 1.0) for m in range(0, 600, 2)]
    put(spark, source, [*rows, *rows[::3]])
    stream = lambda: streaming.distinct_rows(streaming.with_sentinels(spark.readStream.schema(SCHEMA).parquet(source), ends), ["symbol", "id"], "ts", "2 hours")
    held = [state_rows(streaming.run_append(stream(), out, check))]
    put(spark, source, rows[-40:])
    held.append(state_rows(streaming.run_append(stream(), out, check)))
    assert spark.read.parquet(out).count() == 300 == spark.read.parquet(out).select("id").distinct().count()
    # keys of four hours: the delay before the watermark, and as long behind it
    assert held == [120, 120]
    streaming.put_sentinel(spark, spark.createDataFrame([], SCHEMA).schema, ends, ts=T0 + timedelta(days=9), symbol="end", id=-1)
    assert state_rows(streaming.run_append(stream(), out, check)) == 1


# ---- bucketed Silver


def test_factors_over_a_bucketed_table_take_no_exchange(spark):
    silver = days(spark, 3, [f"S{i}" for i in range(12)])
    spark.sql("drop table if exists silver_bucketed")
    files.save_bucketed_silver(silver, "silver_bucketed", 5)
    names = [f for f in registry.list_factors() if f != "funding_momentum"]
    factors = {f: (f, None) for f in names}
    got = registry.compute_factors(spark.table("silver_bucketed"), factors, files.PLACE)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 0 and "Bucketed: true" in plan
    key = lambda r: (r.symbol, r.open_time_utc)
    want = sorted(registry.compute_factors(silver, factors, files.PLACE).collect(), key=key)
    assert [[r[f] for f in names] for r in sorted(got.collect(), key=key)] == [[r[f] for f in names] for r in want]
    spark.sql("drop table silver_bucketed")
