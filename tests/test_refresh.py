"""Incremental refresh in time buckets, staged writes with quarantine, exchanges as keys, and the catalogue."""

import json
import random
from dataclasses import replace
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

import barlight.factors  # noqa: F401
from barlight.operators import reach, registry
from barlight.operators.schemas import SILVER_COLUMNS
from barlight.operators.validate import ContractError
from barlight.plans import research
from barlight.sources import files, refresh
from barlight.sources.layout import Lake
from barlight.sources.replay import Downloader
from barlight.streaming import bars as streaming

from .test_candles import silver
from .test_factors import COLUMNS, alike

T0 = datetime(2024, 1, 1, tzinfo=UTC)
FEW = ["momentum", "vol_reversion", "rsi"]


def place():
    return {"exchange": F.lit("x"), "market": F.lit("spot")}


def lake(tmp_path):
    return Lake(str(tmp_path / "lake"), "yyyy-MM-dd")


def days(spark, n, symbols=("AAA", "BBB"), seed=1, exchange="x"):
    """Hourly candles of n days."""
    rng, rows = random.Random(seed), []
    for s in symbols:
        for h in range(24 * n):
            t, o, c = T0 + timedelta(hours=h), rng.uniform(1, 2), rng.uniform(1, 2)
            rows.append((t, t + timedelta(hours=1) - timedelta(milliseconds=1), o, max(o, c) + 0.1, min(o, c) - 0.1, c, 5.0, 7.0, 2.0, 3.0, 3, s, "1h", exchange, "spot"))
    return spark.createDataFrame(rows, ", ".join([*(f"{c} {t}" for c, t in zip(SILVER_COLUMNS, ["timestamp"] * 2 + ["double"] * 8 + ["bigint"] + ["string"] * 2, strict=True)), "exchange string", "market string"]))


def gold(spark, at, factors=FEW):
    rows = files.read_gold(spark, at).where(F.col("factor_name").isin(factors)).collect()
    out = {(r.factor_name, r.exchange, r.symbol, r.open_time_utc): r.value for r in rows}
    assert len(out) == len(rows)
    return out


def written(at, layer):
    """Partition folders with the names of their files."""
    from pathlib import Path

    out = {}
    for p in Path(getattr(at, layer)).rglob("*.parquet"):
        out.setdefault(str(p.parent.relative_to(getattr(at, layer))), set()).add(p.name)
    return out


def full(spark, tmp_path, bars, factors=FEW):
    at = Lake(str(tmp_path), "yyyy-MM-dd")
    refresh.merge_silver(bars, at)
    refresh.refresh_gold(spark, at, refresh.changes(bars), factors)
    return gold(spark, at, factors)


def bytes_scanned(df):
    """Bytes of files that the scans of a plan have looked at, once it has run."""
    spark = df.sparkSession
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = df.select("*")
        plan = again._jdf.queryExecution().executedPlan()
        again._jdf.queryExecution().toRdd().count()
        leaves = plan.collectLeaves()
        return sum(leaves.apply(i).metrics().apply("filesSize").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("filesSize"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


# ---- lookback


@pytest.mark.parametrize(("name", "params", "bars"), [("momentum", {"window": 7}, 7), ("sma_dev", {"window": 20}, 19), ("rsi", {"window": 14}, 14), ("return_momentum", {"window": 5}, 5), ("hist_vol", {"window": 20}, 20), ("vol_reversion", {"short": 5, "long": 30}, 30), ("taker_imbalance", None, 0), ("amihud", {"window": 20}, 20), ("funding_momentum", {"fast": 8, "slow": 24}, 23)])
def test_lookback_is_worked_out_from_the_windows(spark, name, params, bars):
    df = spark.createDataFrame([], COLUMNS)
    assert registry.lookback({"v": (name, params)}, df) == bars
    assert reach.reaches(registry.compute_factor(name, df, params), ["value"])["value"].ahead == 0


def test_lookback_is_the_one_that_values_have(spark):
    """Changing the bar just within reach changes a value, one further back doesn't."""
    rng = random.Random(2)
    rows = [("A", "1h", T0 + timedelta(hours=i), *[c := rng.uniform(1, 2)] * 3, c, 1.0 + i % 3, 2.0 + i % 5, 0.5, 0.01 * i) for i in range(60)]
    for name in registry.list_factors():
        bars = int(registry.lookback({"v": (name, None)}, spark.createDataFrame([], COLUMNS)))

        def last(changed, name=name):
            spoilt = [r if i != changed else (*r[:3], *(x * (3 + k) for k, x in enumerate(r[3:]))) for i, r in enumerate(rows)]
            return registry.compute_factor(name, spark.createDataFrame(spoilt, COLUMNS)).where(F.col("open_time_utc") == F.lit(rows[-1][2])).first()["value"]

        plain = last(None)
        assert last(59 - bars) != plain, name
        assert last(59 - bars - 1) == plain, name


# ---- refresh


def test_late_bars_rewrite_only_the_buckets_they_reach(spark, tmp_path):
    """One series of 40 days lacks three hours of its twentieth day: of 40 buckets few are read, fewer written, and the values are those of a full run."""
    at, bars = lake(tmp_path), days(spark, 40)
    late = (F.col("symbol") == "AAA") & (F.to_date("open_time_utc") == F.lit("2024-01-20").cast("date")) & F.hour("open_time_utc").isin(3, 4, 5)
    early = bars.where(~late)
    assert full(spark, tmp_path / "lake", early)
    silver_before, gold_before = written(at, "silver"), written(at, "gold")
    arrived = bars.where(late)
    refresh.merge_silver(arrived, at)
    changed = refresh.changes(arrived)
    refresh.refresh_gold(spark, at, changed, FEW)
    assert alike(gold(spark, at), full(spark, tmp_path / "whole", bars))
    silver_after, gold_after = written(at, "silver"), written(at, "gold")
    moved = {k for k in silver_after if silver_after[k] != silver_before.get(k)}
    assert {k.split("/")[-3:][0] for k in moved} == {"symbol=AAA"} and {k.split("bucket=")[1] for k in moved} == {"2024-01-20"}
    moved = {k for k in gold_after if gold_after[k] != gold_before.get(k)}
    # 20 bars of lookback end in the day after; three factors
    assert {k.split("bucket=")[1] for k in moved} == {"2024-01-20", "2024-01-21"} and len(moved) == 6
    table = files.read_lake_silver(spark, at)
    parts = refresh.reached(refresh.bars_in_buckets(table, changed), changed, 20, at)
    assert sorted((r.bucket[-2:], r.write) for r in parts.collect()) == [("19", False), ("20", True), ("21", True)]
    assert bytes_scanned(refresh.in_place(table, parts)) < bytes_scanned(table) / 20


def test_buckets_with_few_bars_are_passed_over(spark, tmp_path):
    """Where days have three bars each, twenty bars reach over seven days on either side; without bound, over all."""
    at = lake(tmp_path)
    bars = days(spark, 30, ("AAA",)).where(F.hour("open_time_utc") < 3)
    refresh.merge_silver(bars, at)
    changed = refresh.changes(bars.where(F.to_date("open_time_utc") == F.lit("2024-01-15").cast("date")))
    table = files.read_lake_silver(spark, at)
    counts = refresh.bars_in_buckets(table, changed)
    told = lambda n: {int(r.bucket[-2:]): r.write for r in refresh.reached(counts, changed, n, at).collect()}
    assert told(20) == {d: d >= 15 for d in range(8, 23)}
    assert told(0) == {15: True}
    assert told(float("inf")) == {d: d >= 15 for d in range(1, 31)}


def test_more_buckets_than_are_named(spark, tmp_path, monkeypatch):
    at, bars = lake(tmp_path), days(spark, 12)
    monkeypatch.setattr(refresh, "NAMED", 2)
    late = F.dayofmonth("open_time_utc") == 6
    full(spark, tmp_path / "lake", bars.where(~late))
    refresh.merge_silver(bars.where(late), at)
    refresh.refresh_gold(spark, at, refresh.changes(bars.where(late)), FEW)
    assert alike(gold(spark, at), full(spark, tmp_path / "whole", bars))


def test_new_rows_stand_for_old_ones(spark, tmp_path):
    at, touched = lake(tmp_path), []
    streaming.refresh_silver(silver(spark, (0, 1, 2)).withColumns(place()), at)
    newer = silver(spark, (2, 3)).withColumns(place() | {"close": F.lit(1.75)})
    for _ in range(2):
        streaming.refresh_silver(newer, at, lambda t: touched.extend(t.collect()))
    rows = files.read_lake_silver(spark, at).orderBy("open_time_utc").collect()
    assert [r.close for r in rows] == [1.5, 1.5, 1.75, 1.75]
    assert [(t.symbol, t.changed_from.hour, t.changed_to.hour) for t in touched] == [("BTC", 2, 3)] * 2


def test_merges_that_broke_off(spark, tmp_path):
    """One that broke off with its rows staged is finished by the next; one that broke off before that leaves nothing."""
    at = lake(tmp_path)
    rows = lambda hours: files.in_buckets(silver(spark, hours).withColumns(place()), at)
    hours = lambda: sorted(r.open_time_utc.hour for r in files.read_lake_silver(spark, at).collect())
    refresh.merge_silver(rows((0, 1, 2)), at)
    files.stage(rows((0, 1, 2, 5)), refresh._staged(at), files.SILVER_PARTS)
    refresh.merge_silver(rows((6,)), at)
    assert hours() == [0, 1, 2, 5, 6]
    files.stage(rows((9,)), refresh._staged(at), files.SILVER_PARTS)
    (tmp_path / "lake" / "silver" / "klines_staged" / "_SUCCESS").unlink()
    refresh.merge_silver(rows((7,)), at)
    assert hours() == [0, 1, 2, 5, 6, 7]


def test_broken_rows_stop_a_merge_or_go_to_quarantine(spark, tmp_path):
    at = lake(tmp_path)
    refresh.merge_silver(silver(spark, (0,)).withColumns(place()), at)
    bad = silver(spark, (1, 2, 3), high=0.1).withColumns(place()).unionByName(silver(spark, (3,)).withColumns(place() | {"close": F.lit(1.25)}))
    with pytest.raises(ContractError) as e:
        refresh.merge_silver(bad, at)
    assert (e.value.rule, e.value.n) == ("duplicate times", 1)
    assert files.read_lake_silver(spark, at).count() == 1
    for _ in range(2):
        told = refresh.merge_silver(bad, at, quarantine=True)
        assert told["duplicate times"] == 1 and told["prices out of order"] == 1
    assert sorted(r.open_time_utc.hour for r in files.read_lake_silver(spark, at).collect()) == [0, 1, 3]
    aside = spark.read.parquet(at.quarantine)
    assert sorted(r.broken for r in aside.dropDuplicates(["open_time_utc", "broken"]).collect()) == ["duplicate times", "prices out of order"]


def test_the_contract_is_checked_in_the_pass_that_writes(spark, tmp_path):
    """Bronze is scanned once, however many rules there are."""
    at, seen = lake(tmp_path), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    arrived = days(spark, 3).coalesce(1)
    counted = arrived.mapInArrow(count, arrived.schema)
    files.stage(files.in_buckets(counted, at), refresh._staged(at), files.SILVER_PARTS)
    assert seen.value == arrived.count()


def test_bronze_is_read_once(spark, tmp_path):
    """Building Silver scans Bronze in one job, and leaves what was there where the contract is broken."""
    from .test_candles import WIRE, wire

    later = [3_600_000, *WIRE[1:6], 7_199_999, *WIRE[7:]]
    files.write_bronze_klines(wire(spark, WIRE, later).drop("broken"), f"{tmp_path}/b")
    scans = []
    kept = files.silver_projection

    def watched(bronze, *a):
        scans.append(bronze)
        return kept(bronze, *a)

    files.silver_projection = watched
    try:
        assert files.build_silver(spark, f"{tmp_path}/b", f"{tmp_path}/s").count() == 2
    finally:
        files.silver_projection = kept
    assert len(scans) == 1 and not (tmp_path / "s_staged").exists()
    files.write_bronze_klines(wire(spark, WIRE, WIRE).drop("broken"), f"{tmp_path}/bad")
    with pytest.raises(ContractError, match="duplicate times"):
        files.build_silver(spark, f"{tmp_path}/bad", f"{tmp_path}/s")
    assert files.read_silver_klines(spark, f"{tmp_path}/s").count() == 2
    unsafe = wire(spark, WIRE).drop("broken").withColumn("symbol", F.lit("a/b"))
    files.write_bronze_klines(unsafe, f"{tmp_path}/unsafe")
    with pytest.raises(ContractError, match="safe name"):
        files.build_silver(spark, f"{tmp_path}/unsafe", f"{tmp_path}/s")


# ---- runs


@pytest.fixture
def recordings(tmp_path):
    def record(name, seed, hours=60):
        rng = random.Random(seed)
        for s in ("AAA", "BBB"):
            folder = tmp_path / name / "klines" / s / "1h"
            folder.mkdir(parents=True)
            lines = []
            for h in range(hours):
                o, c = rng.uniform(1, 2), rng.uniform(1, 2)
                ms = int((T0 + timedelta(hours=h)).timestamp() * 1000)
                lines.append(json.dumps([ms, str(o), str(max(o, c) + 0.1), str(min(o, c) - 0.1), str(c), "5", ms + 3_599_999, "7", 3, "2", "3", "0"]))
            (folder / "x.json").write_text("\n".join(lines))
        return str(tmp_path / name)

    return record


def test_two_exchanges_with_the_same_names(spark, tmp_path, recordings):
    """The second exchange's candles are neither lost nor mixed with the first's, in any layer, nor are those of another market."""
    at = lake(tmp_path)
    runs = [research.Run(recordings(n, k), at, ["AAA", "BBB"], "1h", "2024-01-01", "2024-01-03", exchange=n, market=m, factors=FEW) for k, (n, m) in enumerate((("alpha", "spot"), ("beta", "spot"), ("gamma", "futures")))]
    for run in runs:
        research.incremental(spark, run)
    bronze = files.read_lake_bronze(spark, at.bronze)
    assert {(r.exchange, r.market): r["count"] for r in bronze.groupBy("exchange", "market").count().collect()} == {("alpha", "spot"): 96, ("beta", "spot"): 96, ("gamma", "futures"): 96}
    values = gold(spark, at)
    assert len(values) == 3 * 96 * len(FEW)
    for k, run in enumerate(runs):
        alone = replace(run, lake=Lake(str(tmp_path / f"alone{k}"), at.bucket))
        for step in (research.download, research.clean, research.compute):
            step(spark, alone)
        assert alike({x: v for x, v in values.items() if x[1] == run.exchange}, gold(spark, alone.lake))
        assert research.panel(spark, run, "momentum").count() == 96
    assert Downloader(spark, runs[1].recordings, at.bronze, "Beta").new_bars(["AAA"], "1h", T0, T0 + timedelta(hours=48)).count() == 0


def test_a_factor_that_is_new_gets_all_its_values(spark, tmp_path, recordings):
    run = research.Run(recordings("r", 3), lake(tmp_path), ["AAA", "BBB"], "1h", "2024-01-01", "2024-01-02", factors=["momentum"])
    research.incremental(spark, run)
    before = written(run.lake, "gold")
    research.incremental(spark, replace(run, factors=["momentum", "rsi"]))
    assert len(gold(spark, run.lake, ["rsi"])) == len(gold(spark, run.lake, ["momentum"])) == 48
    after = written(run.lake, "gold")
    assert all(after[k] == v for k, v in before.items())


# ---- catalogue


def test_catalogue_opens_no_file(spark, tmp_path):
    """The files hold no Parquet, so that opening one would fail."""
    at = Lake(str(tmp_path))
    for factor, symbol in (("rsi", "A"), ("rsi", "B=1"), ("Beta", "A"), ("sma dev", "{x}")):
        name = symbol.replace("=", "%3D").replace("{", "%7B")
        folder = tmp_path / "gold" / "factors" / f"factor_name={factor}" / "params=default" / "exchange=x" / "market=spot" / f"symbol={name}" / "interval=1h" / "bucket=2024-01"
        folder.mkdir(parents=True)
        (folder / "part-0.parquet").write_text("no parquet")
    assert files.list_gold_factors(spark, at) == ["Beta", "rsi", "sma dev"]
    assert files.list_gold_factors(spark, at, symbol="A") == ["Beta", "rsi"]
    assert files.list_gold_factors(spark, at, symbol="B=1", interval="1h") == ["rsi"]
    assert files.list_gold_factors(spark, at, symbol="{x}") == ["sma dev"]
    assert files.list_gold_factors(spark, at, symbol="A", interval="1d") == []
    assert files.list_gold_factors(spark, Lake(str(tmp_path / "none"))) == []
