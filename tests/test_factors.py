"""Registry, factors, evaluation, look-ahead, replay, runs and streams."""

import json
import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

import barlight.factors  # noqa: F401
from barlight.functions.series import SeriesFrame
from barlight.operators import evaluate, forward_check, registry
from barlight.operators.asof import asof_backward
from barlight.operators.spread import average_ranks
from barlight.plans import catalogue, research
from barlight.plans.report import report_data, write_report
from barlight.sources.files import read_gold
from barlight.sources.layout import Lake
from barlight.sources.replay import Downloader, ReplayClient

T0 = datetime(2024, 1, 1, tzinfo=UTC)
COLUMNS = "symbol string, interval string, open_time_utc timestamp, open double, high double, low double, close double, volume double, quote_volume double, taker_buy_volume double, funding_rate double"


def series(spark, closes, symbol="A"):
    rows = [(symbol, "1h", T0 + timedelta(hours=i), c, c, c, c, 1.0 + i % 3, 2.0 + i % 5, 0.5, None if i % 4 else 0.01 * i) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, COLUMNS)


def values(df):
    return [r.value for r in df.orderBy("open_time_utc").collect()]


@pytest.fixture
def clean_registry(monkeypatch):
    monkeypatch.setattr(registry, "FACTOR_REGISTRY", {})


def test_parameters_are_kept_apart(spark, clean_registry):
    defaults = {"scale": 2, "deep": {"x": 1}}

    @registry.register_factor("scaled", category="c", default_params=defaults)
    def make(params):
        """Scaled close."""
        scale = params.get("scale", 5)
        params["scale"] = 99
        params.get("deep", {})["x"] = 99
        return lambda s: s.col("close") * scale

    df = series(spark, [1.5])
    assert values(registry.compute_factor("scaled", df)) == [3.0]
    assert values(registry.compute_factor("scaled", df)) == [3.0]
    assert values(registry.compute_factor("scaled", df, {})) == [7.5]
    mine = {"scale": 4}
    assert values(registry.compute_factor("scaled", df, mine)) == [6.0]
    assert mine == {"scale": 4} and defaults["deep"] == {"x": 1}
    meta = registry.get_factor_metadata("scaled")
    assert meta["description"] == "Scaled close."
    meta["default_params"]["scale"] = 0
    assert registry.get_factor_metadata("scaled")["default_params"]["scale"] == 2
    assert registry.list_factors() == registry.list_factors("c") == ["scaled"]
    assert registry.list_factors("d") == []
    with pytest.raises(ValueError):
        registry.register_factor("scaled")(make)
    for f in (registry.get_factor_metadata, registry.build_factor):
        with pytest.raises(KeyError):
            f("none")
    assert registry.register_factor()(make) is make
    assert registry.get_factor_metadata("make")["category"] == "uncategorised"


def test_bad_factors_are_refused(spark, clean_registry):
    registry.register_factor("number")(lambda params: lambda s: 3)
    df = series(spark, [1.0])
    with pytest.raises(TypeError):
        registry.compute_factor("number", df)
    with pytest.raises(ValueError):
        registry.compute_factor("number", df.drop("volume"))
    for function in (lambda d: 3, lambda d: pd.Series([1.0, 2.0])):
        with pytest.raises(Exception, match="pandas factor"):
            registry.pandas_factor(function, df).collect()


def test_class_factor(spark):
    class Twice(registry.BaseFactor):
        def compute(self, frame: SeriesFrame) -> Column:
            return frame.col("close") * 2

    assert Twice().name == "Twice"
    assert isinstance(Twice(), registry.FactorFunction)
    with pytest.raises(TypeError):
        registry.BaseFactor()


def test_rsi_by_hand(spark):
    got = values(registry.compute_factor("rsi", series(spark, [1.0, 2.0, 3.0, 2.0, 2.0, 2.0, 5.0]), {"window": 3}))
    assert got[:3] == [None] * 3
    assert got[3:] == pytest.approx([66.6666667, 50.0, 0.0, 100.0])
    assert values(registry.compute_factor("rsi", series(spark, [2.0] * 5), {"window": 3})) == [None] * 5


def pandas_of(name, d):
    r, lr = d.close.pct_change(fill_method=None), np.log(d.close / d.close.shift())
    return {
        "sma_dev": lambda: d.close / d.close.rolling(4).mean() - 1,
        "momentum": lambda: d.close / d.close.shift(4) - 1,
        "return_momentum": lambda: r.rolling(4).sum(),
        "hist_vol": lambda: lr.rolling(4).std(),
        "realized_vol": lambda: np.sqrt((r * r).rolling(4).sum()),
        "volume_change": lambda: d.volume / d.volume.rolling(4).mean() - 1,
        "turnover_rate": lambda: d.quote_volume / d.quote_volume.rolling(4).mean(),
        "amihud": lambda: (r.abs() / d.quote_volume).rolling(4).mean(),
        "taker_imbalance": lambda: 2 * d.taker_buy_volume / d.volume - 1,
    }[name]()


@pytest.mark.parametrize("name", ["sma_dev", "momentum", "return_momentum", "hist_vol", "realized_vol", "volume_change", "turnover_rate", "amihud", "taker_imbalance"])
def test_factors_against_pandas(spark, name):
    rng = random.Random(3)
    closes = [rng.uniform(1, 2) for _ in range(15)] + [None] + [rng.uniform(1, 2) for _ in range(10)] + [float("nan")] + [1.0] * 8
    df = series(spark, closes).unionByName(series(spark, closes[::-1], "B"))
    got = registry.compute_factor(name, df, {"window": 4}).toPandas()
    for _, g in got.groupby("symbol"):
        g = g.sort_values("open_time_utc")
        want = pandas_of(name, g).astype(float).to_numpy()
        have = g.value.astype(float).to_numpy()
        assert np.allclose(have, want, atol=1e-9, equal_nan=True)


def test_all_factors_share_one_shuffle(spark):
    df = series(spark, [1.0, 2.0, 3.0])
    out = registry.compute_factors(df, {f: (f, None) for f in registry.list_factors()})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert registry.panel(out, ["rsi", "momentum"]).count() == 6


@pytest.mark.parametrize("name", ["sma_dev", "rsi", "vol_reversion", "momentum", "amihud", "funding_momentum", "taker_imbalance"])
def test_no_factor_looks_ahead(spark, name):
    rng = random.Random(4)
    df = series(spark, [rng.uniform(1, 2) for _ in range(40)])
    cuts = [T0 + timedelta(hours=h) for h in (25, 33)]
    compute = lambda d: registry.compute_factor(name, d)
    rows = forward_check.prefix_mismatches(compute, df, cuts).collect()
    assert [(r.n_rows, r.n_mismatch) for r in rows] == [(1, 0)] * 2
    assert forward_check.looks_ahead(compute(df)) == []


def test_leaks_are_found(spark):
    from pyspark.sql.window import Window

    rng = random.Random(5)
    df = series(spark, [rng.uniform(1, 2) for _ in range(30)])
    key = Window.partitionBy("symbol")
    for leak in (F.avg("close").over(key), F.lead("close").over(key.orderBy("open_time_utc")), F.lag("close", -1).over(key.orderBy("open_time_utc"))):
        compute = lambda d, leak=leak: d.withColumn("value", leak)
        assert forward_check.prefix_mismatches(compute, df, [T0 + timedelta(hours=9)]).first().n_mismatch == 1
        assert forward_check.looks_ahead(compute(df))
    assert forward_check.check_timestamp_alignment(df, df)
    assert not forward_check.check_timestamp_alignment(df.union(df), df)
    assert not forward_check.check_timestamp_alignment(df, df.limit(3))
    returns = df.select("symbol", "open_time_utc", F.expr("open_time_utc + interval 1 hour").alias("ret_start"), F.expr("open_time_utc + interval 2 hour").alias("ret_end"))
    known = df.select("symbol", "open_time_utc", F.expr("open_time_utc + interval 59 minute").alias("available_at"))
    assert forward_check.check_forward_return_alignment(known, returns, ("symbol", "open_time_utc"))
    assert not forward_check.check_forward_return_alignment(known, returns.limit(3), ("symbol", "open_time_utc"))
    late = known.withColumn("available_at", F.col("available_at") + F.expr("interval 2 hour"))
    assert not forward_check.check_forward_return_alignment(late, returns, ("symbol", "open_time_utc"))


# ---- evaluation


def make_panel(spark, times=6, names=9, seed=6):
    rng = random.Random(seed)
    rows = [(f"s{k}", T0 + timedelta(days=t), rng.choice((1.0, 2.0, 3.0, None, rng.random())), rng.choice((0.1, -0.1, None, rng.random()))) for t in range(times) for k in range(names)]
    return spark.createDataFrame(rows, "symbol string, open_time timestamp, value double, fwd_ret double")


def test_average_ranks(spark):
    df = spark.createDataFrame([(1, v) for v in (3.0, 1.0, 3.0, 2.0)], "g int, v double")
    assert sorted((r.v, r.k) for r in df.withColumn("k", evaluate.average_rank("v", ["g"])).collect()) == [(1, 1), (2, 2), (3, 3.5), (3, 3.5)]
    many = spark.createDataFrame([(float(random.Random(i).randrange(60)),) for i in range(500)], "v double")
    got = average_ranks(many, "v", "k").toPandas()
    assert np.allclose(got.k, got.v.rank())


def test_ic_against_pandas(spark):
    panel = make_panel(spark)
    d = panel.toPandas().dropna()
    want = {t: g.value.rank().corr(g.fwd_ret.rank()) for t, g in d.groupby("open_time")}
    got = {r.open_time: r.ic for r in evaluate.ic_series(panel).collect()}
    assert len(got) == len(want)
    assert sorted(got.values()) == pytest.approx(sorted(want.values()))
    assert evaluate.compute_rank_ic(panel) == pytest.approx(d.value.rank().corr(d.fwd_ret.rank()))
    flat = spark.createDataFrame([("a", 1, 1.0, 0.5), ("b", 1, 1.0, 0.2)], "symbol string, open_time int, value double, fwd_ret double")
    assert evaluate.ic_series(flat).first().ic is None
    with pytest.raises(ValueError):
        evaluate.ic_series(panel, method="kendall")


def test_groups_turnover_and_costs(spark):
    rows = [(s, t, v, r) for t, order in ((1, "abcd"), (2, "abdc"), (3, "dcba")) for v, (s, r) in enumerate(zip(order, (0.0, 0.1, 0.2, 0.4), strict=True))]
    panel = spark.createDataFrame([(s, t, float(v), r) for s, t, v, r in rows], "symbol string, open_time int, value double, fwd_ret double")
    assert [r.mean_ret for r in evaluate.grouping_backtest(panel, 4).orderBy("bucket").collect()] == pytest.approx([0.0, 0.1, 0.2, 0.4])
    costs = evaluate.cost_adjusted_returns(panel, n_groups=4).orderBy("open_time").collect()
    # long d then c then a, short a, a, d
    assert [r.turnover for r in costs] == pytest.approx([1.0, 1.0, 2.0])
    assert [r.net for r in costs] == pytest.approx([0.4 - 0.0015, 0.4 - 0.0015, 0.4 - 0.003])
    assert evaluate.breakeven_cost(panel, 4).first().breakeven_cost == pytest.approx(0.4 / (4 / 3))
    one = evaluate.turnover_analysis(panel.withColumn("factor_name", F.lit("f")), 4).first()
    assert one.n == 8


def test_correlations(spark):
    rng = random.Random(7)
    rows = [(t, a := rng.random(), 2 * a + 0.01 * rng.random(), rng.random() if t % 3 else None, 1.0) for t in range(60)]
    wide = spark.createDataFrame(rows, "open_time int, a double, b double, c double, flat double")
    got = {(r.factor_a, r.factor_b): r.rho for r in evaluate.correlation_matrix(wide, ["a", "b", "c", "flat"]).collect()}
    d = wide.toPandas()
    assert got["a", "b"] == pytest.approx(d.a.corr(d.b))
    assert got["a", "c"] == pytest.approx(d.a.corr(d.c))
    assert got["a", "flat"] is None
    assert [p[:2] for p in evaluate.find_redundant_factors(evaluate.correlation_matrix(wide, ["a", "b", "c"]))] == [("a", "b")]
    with pytest.raises(ValueError):
        evaluate.correlation_matrix(wide, ["a", "b"], "kendall")


def test_forward_returns_stop_at_gaps(spark):
    rows = [("a", T0 + timedelta(hours=h), c) for h, c in ((0, 1.0), (1, 2.0), (3, 4.0))]
    df = spark.createDataFrame(rows, "symbol string, open_time timestamp, close double")
    assert [r.fwd_ret for r in evaluate.forward_returns(df, "1 HOUR").orderBy("open_time").collect()] == [1.0, None, None]


def test_asof(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 5, 0.5), ("a", 7, 0.7), ("b", 6, 0.6)], "k string, u int, v double")
    got = asof_backward(left, right, "t", "u", ["v"], ["k"])
    assert {(r.k, r.t): r.v for r in got.collect()} == {("a", 1): None, ("a", 5): 0.5, ("a", 9): 0.7, ("b", 5): None}


def test_query_finds_leaks_of_any_factor_late_in_a_series(spark, sf, clean_registry):
    """A factor that looks ahead only in the last rows, beyond the three cuts of the SQL."""
    from pyspark.sql.window import Window

    from barlight.plans import catalogue

    hours = [r[0] for r in catalogue.bars.hourly_bars(spark, sf).select("open_time").distinct().orderBy("open_time").collect()]
    late = hours[len(hours) // 2]
    registry.register_factor("late_leak")(lambda p: lambda s: F.when(F.col("open_time") > F.lit(late), F.count("close").over(Window.partitionBy("symbol")).cast("double")))
    rows = catalogue.queries()["forward_check_prefix"](spark, sf).collect()
    assert any(r.n_mismatch > 0 for r in rows)
    assert [r.n_mismatch for r in rows if r.cut in hours[30:33]] == [0, 0, 0]


# ---- runs


@pytest.fixture
def recordings(tmp_path):
    rng = random.Random(8)
    for s in ("AAA", "BBB", "CCC"):
        folder = tmp_path / "rec" / "klines" / s / "1h"
        folder.mkdir(parents=True)
        lines = []
        for h in range(60):
            o, c = rng.uniform(1, 2), rng.uniform(1, 2)
            ms = int((T0 + timedelta(hours=h)).timestamp() * 1000)
            lines.append(json.dumps([ms, str(o), str(max(o, c) + 0.1), str(min(o, c) - 0.1), str(c), "5", ms + 3_599_999, "7", 3, "2", "3", "0"]))
        (folder / "x.json").write_text("\n".join(lines))
    return tmp_path


def test_replay_and_resumed_download(spark, recordings):
    client = ReplayClient(spark, str(recordings / "rec"), "aaa")
    assert client.exchange_name == "replay" and client.ping()
    assert not ReplayClient(spark, str(recordings / "none"), "aaa").ping()
    assert client.fetch_klines("1H", T0, T0 + timedelta(hours=10)).count() == 10
    assert client.fetch_klines("1h", T0, T0 + timedelta(hours=10), limit=3).agg(F.max("open_time")).first()[0] == int((T0 + timedelta(hours=2)).timestamp() * 1000)
    d = Downloader(spark, str(recordings / "rec"), str(recordings / "b"))
    d.download_klines("AAA", "1h", T0, T0 + timedelta(hours=10))
    assert d.new_bars(["AAA", "BBB"], "1h", T0, T0 + timedelta(hours=12)).count() == 2 + 12
    d.download_all(["AAA", "BBB"], "1h", T0, T0 + timedelta(hours=12))
    assert spark.read.parquet(str(recordings / "b")).count() == 24


def test_command_line(spark, recordings, tmp_path):
    assert research.main([]) == 2
    assert research.main(["--dry-run"]) == 0
    args = ["--recordings", str(recordings / "rec"), "--lake", str(recordings / "lake"), "--symbols", "AAA,BBB,CCC", "--interval", "1h", "--start", "2024-01-01", "--reports", str(recordings / "reports")]
    research.STEPS, kept = research.STEPS[:4], research.STEPS
    try:
        assert research.main([*args, "--end", "2024-01-03"], spark) == 0
    finally:
        research.STEPS = kept
    from barlight.sources.files import list_gold_factors

    assert "rsi" in list_gold_factors(spark, Lake(str(recordings / "lake")))
    run = research.Run(str(recordings / "rec"), Lake(str(recordings / "lake")), ["AAA", "BBB", "CCC"], "1h", "2024-01-01", "2024-01-03", factors=["momentum"])
    assert research.assess(spark, run).count() == 1
    page = write_report("momentum", report_data(research.panel(spark, run, "momentum"), run.step, max_lag=3), recordings / "r.html")
    assert page.read_text().count("<svg") == 4


def gold_rows(spark, lake, factors):
    rows = read_gold(spark, lake).where(F.col("factor_name").isin(factors)).collect()
    out = {(r.factor_name, r.symbol, r.open_time_utc): r.value for r in rows}
    assert len(out) == len(rows)
    return out


def alike(a, b):
    return a.keys() == b.keys() and all(a[k] == b[k] or abs(a[k] - b[k]) < 1e-12 for k in a)


FEW = ["momentum", "vol_reversion", "rsi"]


def from_scratch(spark, recordings, name, end):
    run = research.Run(str(recordings / "rec"), Lake(str(recordings / name)), ["AAA", "BBB", "CCC"], "1h", "2024-01-01", end, factors=FEW)
    research.download(spark, run)
    research.clean(spark, run)
    research.compute(spark, run)
    return gold_rows(spark, run.lake, FEW)


def test_incremental_runs_agree_with_full_ones(spark, recordings):
    """Into the same Silver and Gold, after a full run, with a late bar, again, and after runs that broke off between layers."""
    from dataclasses import replace

    late = recordings / "rec" / "klines" / "BBB" / "1h" / "x.json"
    lines = late.read_text().split("\n")
    late.write_text("\n".join(lines[:20] + lines[21:]))
    run = research.Run(str(recordings / "rec"), Lake(str(recordings / "lake")), ["AAA", "BBB", "CCC"], "1h", "2024-01-01", "2024-01-02", factors=FEW)
    for step in (research.download, research.clean, research.compute):
        step(spark, run)
    more = replace(run, end="2024-01-02T06:00:00")
    research.incremental(spark, more)
    assert alike(gold_rows(spark, run.lake, FEW), from_scratch(spark, recordings, "scratch", more.end))
    late.write_text("\n".join(lines))
    research.incremental(spark, more)
    want = from_scratch(spark, recordings, "scratch2", more.end)
    assert len(want) == 3 * 3 * 30
    assert alike(gold_rows(spark, run.lake, FEW), want)
    files = sorted(str(p) for p in (recordings / "lake").rglob("*.parquet"))
    research.incremental(spark, more)
    assert sorted(str(p) for p in (recordings / "lake").rglob("*.parquet")) == files
    # a run that ended after Bronze, and one that ended after Silver
    more = replace(run, end="2024-01-02T09:00:00")
    research.download(spark, more)
    research.incremental(spark, more)
    assert alike(gold_rows(spark, run.lake, FEW), from_scratch(spark, recordings, "scratch3", more.end))
    more = replace(run, end="2024-01-02T12:00:00")
    research.download(spark, more)
    research.clean(spark, more)
    research.incremental(spark, more)
    assert alike(gold_rows(spark, run.lake, FEW), from_scratch(spark, recordings, "scratch4", more.end))


def test_decay_by_steps(spark):
    """Returns to bars at exactly so many steps, across gaps, by plain counting."""
    rng = random.Random(4)
    rows = [(f"s{k}", datetime(2024, 1, 1) + timedelta(hours=h), rng.uniform(1, 2), rng.uniform(-1, 1)) for k in range(6) for h in range(40) if rng.random() > 0.2]
    bars = spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, close double, value double")
    close = {(s, t): c for s, t, c, _ in rows}
    for mode in ("cumulative", "single"):
        want = {}
        for lag in range(1, 6):
            ics = []
            for t in sorted({t for _, t, _, _ in rows}):
                pts = []
                for s, at, c, v in rows:
                    base = c if mode == "cumulative" else close.get((s, t + timedelta(hours=lag - 1)))
                    if at == t and base and (later := close.get((s, t + timedelta(hours=lag)))):
                        pts.append((v, later / base - 1))
                if len(pts) > 1:
                    x, y = (pd.Series(z).rank() for z in zip(*pts, strict=True))
                    if x.std() and y.std():
                        ics.append(x.corr(y))
            want[lag] = (sum(ics) / len(ics), len(ics))
        got = {r.lag: (r.ic_mean, r.n_periods) for r in evaluate.ic_decay(bars, "1 HOUR", 5, mode=mode).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


def test_pooled_rank_correlations(spark):
    rng = random.Random(5)
    rows = [(i, float(rng.randrange(9)), rng.gauss(0, 1) if i % 5 else None, 0.0 if i % 3 else rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double")
    frame = pd.DataFrame(rows, columns=["i", "a", "b", "c"])
    got = {(r.factor_a, r.factor_b): r.rho for r in evaluate.correlation_matrix(df, ["a", "b", "c"], "spearman").collect()}
    for (x, y), rho in got.items():
        both = frame[[x, y]].dropna()
        assert abs(rho - both[x].rank().corr(both[y].rank())) < 1e-9
    assert len(got) == 3


def test_logger_is_attached_once():
    assert research.get_logger("x") is research.get_logger("x")
    assert len(research.get_logger("x").handlers) == 1


# ---- catalogue


def test_queries_and_sql_go_together(spark, sf):
    import duckdb

    assert set(catalogue.oracle_sql()) == set(catalogue.queries())
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    for name in ("bars_hourly", "factor_rsi_14", "ic_summary", "breakeven_cost", "missing_klines", "trade_rules"):
        df = catalogue.queries()[name](spark, sf)
        want = con.execute(catalogue.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns), name
        rows = sorted(map(repr, want.fetchall()))
        assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == rows, name


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert {"bars_hourly", "ic_summary"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from barlight.session import shared_folder

    def session(master, named):
        put = []
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: put[-1] if put else None, setCheckpointDir=put.append)
        return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: named or d))

    assert shared_folder(session("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    assert shared_folder(session("local[4]", None))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            shared_folder(session(master, None))
