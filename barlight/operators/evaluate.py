"""Evaluation of factors on a panel of many series.

A panel has a row for each series and time. Cross-sections are dealt out by time, series by their key; neither is
ever gathered in one task as a whole. Correlations are quotients of covariance and deviations, null where a deviation is 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spread import average_ranks, ntiles

KEY, TIME = "symbol", "open_time"


def correlation(a: str | Column, b: str | Column) -> Column:
    """Aggregate over rows in which both are given."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread != 0, F.covar_pop(x, y) / spread)


def forward_returns(bars: DataFrame, step: str, horizon: int = 1, key: str = KEY, time: str = TIME, close: str = "close") -> DataFrame:
    """The bars with fwd_ret, the return from a bar's close to that of the bar ``horizon`` steps on; null where that bar isn't there."""
    w = Window.partitionBy(key).orderBy(time)
    on_time = F.lead(time, horizon).over(w) == F.col(time) + F.expr(f"INTERVAL {step}") * horizon
    return bars.withColumn("fwd_ret", F.when(on_time & (F.col(close) != 0), F.lead(close, horizon).over(w) / F.col(close) - 1))


def average_rank(value: str, by: Sequence[str]) -> Column:
    """Rank from 1 within ``by``; equal values share the mean of their ranks. Filter nulls out first."""
    order = Window.partitionBy(*by).orderBy(value)
    # equal values are a range frame of the same order, so that one pass gives both
    return F.rank().over(order) + (F.count("*").over(order.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2


def complete(panel: DataFrame, *columns: str) -> DataFrame:
    good = F.lit(True)
    for c in columns:
        good &= F.col(c).isNotNull()
    return panel.where(good)


def ic_series(panel: DataFrame, value: str = "value", ret: str = "fwd_ret", by: Sequence[str] = (TIME,), method: str = "spearman", min_obs: int = 2, spread: bool = False) -> DataFrame:
    """Information coefficient of each cross-section: by, ic, n. ``spread``: ranks by ranges of values, for cross-sections that are too large for one task."""
    rows = complete(panel, value, ret)
    if method == "spearman" and spread:
        rows = average_ranks(average_ranks(rows.select(*by, value, ret), value, "_x", by), ret, "_y", by)
    elif method == "spearman":
        rows = rows.select(*by, average_rank(value, by).alias("_x"), average_rank(ret, by).alias("_y"))
    elif method == "pearson":
        rows = rows.select(*by, F.col(value).alias("_x"), F.col(ret).alias("_y"))
    else:
        raise ValueError(f"unknown method: {method!r}")
    return rows.groupBy(*by).agg(correlation("_x", "_y").alias("ic"), F.count("*").alias("n")).where(F.col("n") >= min_obs)


def compute_rank_ic(panel: DataFrame, value: str = "value", ret: str = "fwd_ret", by: str | None = None) -> float | None | DataFrame:
    """Rank correlation of factor and forward return: one number over the pooled rows, or a series by time."""
    return ic_series(panel, value, ret, (by,)) if by else pooled_rank_ic(panel, value, ret).first()["ic"]


def pooled_rank_ic(panel: DataFrame, value: str = "value", ret: str = "fwd_ret") -> DataFrame:
    rows = complete(panel, value, ret).select(value, ret)
    ranked = average_ranks(average_ranks(rows, value, "_x"), ret, "_y")
    return ranked.agg(correlation("_x", "_y").alias("ic"), F.count("*").alias("n"))


def ic_summary(panel: DataFrame, value: str = "value", ret: str = "fwd_ret", factor: str = "factor_name", time: str = TIME, min_obs: int = 2, method: str = "spearman") -> DataFrame:
    """For each factor of a long panel: mean and deviation of its ICs, their quotient, the share above 0 and their number."""
    ics = ic_series(panel, value, ret, (factor, time), method, min_obs).where(F.col("ic").isNotNull())
    out = ics.groupBy(factor).agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("win_rate"), F.count("*").alias("n_periods"))
    return out.select(factor, "ic_mean", "ic_std", F.when(F.col("ic_std") != 0, F.col("ic_mean") / F.col("ic_std")).alias("icir"), "win_rate", "n_periods")


def ranked_factors(summary: DataFrame, k: int, factor: str = "factor_name") -> DataFrame:
    """The ``k`` factors with the largest mean IC in size."""
    return summary.orderBy(F.abs("ic_mean").desc_nulls_last(), factor).limit(k)


def grouped(panel: DataFrame, n_groups: int = 5, value: str = "value", ret: str = "fwd_ret", key: str = KEY, time: str = TIME, spread: bool = False) -> DataFrame:
    """Complete rows with ``bucket``: 1 to n_groups by value in each cross-section, equal values by key. ``spread``: for cross-sections that are too large for one task."""
    rows = complete(panel, value, ret)
    if spread:
        return ntiles(rows, n_groups, [value, key], "bucket", [time])
    return rows.withColumn("bucket", F.ntile(n_groups).over(Window.partitionBy(time).orderBy(value, key)))


def grouping_backtest(panel: DataFrame, n_groups: int = 5, value: str = "value", ret: str = "fwd_ret", key: str = KEY, time: str = TIME) -> DataFrame:
    """bucket, mean_ret, n."""
    return grouped(panel, n_groups, value, ret, key, time).groupBy("bucket").agg(F.avg(ret).alias("mean_ret"), F.count("*").alias("n"))


def long_short_returns(panel: DataFrame, n_groups: int = 5, value: str = "value", ret: str = "fwd_ret", key: str = KEY, time: str = TIME) -> DataFrame:
    """time, gross: mean return of the top less that of the bottom bucket, at times that have both."""
    rows = grouped(panel, n_groups, value, ret, key, time)
    side = lambda b: F.avg(F.when(F.col("bucket") == b, F.col(ret)))
    return rows.groupBy(time).agg((side(n_groups) - side(1)).alias("gross")).where(F.col("gross").isNotNull())


def ic_decay(bars: DataFrame, step: str, max_lag: int = 20, value: str = "value", close: str = "close", key: str = KEY, time: str = TIME, mode: str = "cumulative") -> DataFrame:
    """lag, ic_mean, n_periods: mean rank IC against returns over 1 to ``max_lag`` steps, or with mode 'single' of that step alone.

    ``step`` has a fixed length, so no months.
    """
    # each bar with the bars up to max_lag rows on, in one pass over its series; those at a whole number of steps become rows
    coming = Window.partitionBy(key).orderBy(time).rowsBetween(0, max_lag)
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    length = micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {step}"))
    near = bars.select(time, value, F.col(close).alias("_c"), F.collect_list(F.struct(F.col(time).alias("t"), F.col(close).alias("c"))).over(coming).alias("_on"))
    ahead = lambda x: micros(x["t"]) - micros(F.col(time))
    before = lambda i: F.get("_on", i - 1)
    base = (lambda x, i: F.col("_c")) if mode == "cumulative" else (lambda x, i: F.when(micros(x["t"]) - micros(before(i)["t"]) == length, before(i)["c"]))
    found = F.transform("_on", lambda x, i: F.struct((ahead(x) / length).alias("lag"), x["c"].alias("c"), base(x, i).alias("base")))
    on_time = F.filter(found, lambda x: (x["lag"] >= 1) & (x["lag"] <= max_lag) & (x["lag"] == F.floor(x["lag"])) & (x["base"] != 0))
    rows = near.where(F.col(value).isNotNull()).select(time, value, F.explode(on_time).alias("_e")).select(time, value, F.col("_e.lag").cast("int").alias("lag"), (F.col("_e.c") / F.col("_e.base") - 1).alias("r"))
    ics = ic_series(rows, value, "r", ("lag", time))
    return ics.where(F.col("ic").isNotNull()).groupBy("lag").agg(F.avg("ic").alias("ic_mean"), F.count("*").alias("n_periods"))


def turnover_analysis(panel: DataFrame, n_groups: int = 5, value: str = "value", factor: str = "factor_name", key: str = KEY, time: str = TIME) -> DataFrame:
    """For each factor, from one row of a series to its next: mean change of its rank share, correlation of the shares, share of bucket changes."""
    rows = complete(panel, value)
    by = [factor, time]
    rows = rows.select(factor, time, key, (average_rank(value, by) / F.count("*").over(Window.partitionBy(*by))).alias("share"), F.ntile(n_groups).over(Window.partitionBy(*by).orderBy(value, key)).alias("bucket"))
    w = Window.partitionBy(factor, key).orderBy(time)
    moved = rows.withColumn("share0", F.lag("share").over(w)).withColumn("bucket0", F.lag("bucket").over(w)).where(F.col("share0").isNotNull())
    return moved.groupBy(factor).agg(F.avg(F.abs(F.col("share") - F.col("share0"))).alias("mean_rank_change"), correlation("share", "share0").alias("rank_autocorr"), F.avg((F.col("bucket") != F.col("bucket0")).cast("double")).alias("bucket_change_rate"), F.count("*").alias("n"))


def correlation_matrix(wide: DataFrame, factors: Sequence[str], method: str = "pearson", by: Sequence[str] = ()) -> DataFrame:
    """factor_a, factor_b, rho for all pairs a < b, over rows that have both.

    Pooled, or the mean over cross-sections with ``by``. Spearman ranks a pair's complete rows, all together or within each cross-section.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method: {method!r}")
    pairs = list(combinations(sorted(factors), 2))
    if method == "pearson":
        values = wide.groupBy(*by).agg(*[correlation(a, b).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)])
        long = values.select(F.explode(F.array(*[F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), F.col(f"_r{i}").alias("rho")) for i, (a, b) in enumerate(pairs)])).alias("e")).select("e.*")
    else:
        rows = wide.select(*by, F.explode(F.array(*[F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])).alias("e")).select(*by, "e.*")
        group = ["factor_a", "factor_b", *by]
        rows = complete(rows, "x", "y")
        if by:
            ranked = rows.select(*group, average_rank("x", group).alias("x"), average_rank("y", group).alias("y"))
        else:
            ranked = average_ranks(average_ranks(rows, "x", "_x", group), "y", "_y", group).select(*group, F.col("_x").alias("x"), F.col("_y").alias("y"))
        long = ranked.groupBy(*group).agg(correlation("x", "y").alias("rho"))
    return long.groupBy("factor_a", "factor_b").agg(F.avg("rho").alias("rho"))


def redundant_factors(matrix: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs whose correlation is over the threshold in size, largest first."""
    return matrix.where(F.abs("rho") > threshold).orderBy(F.abs("rho").desc(), "factor_a", "factor_b")


def find_redundant_factors(matrix: DataFrame, threshold: float = 0.8) -> list[tuple[str, str, float]]:
    return [(r["factor_a"], r["factor_b"], r["rho"]) for r in redundant_factors(matrix, threshold).collect()]


def turnover_series(panel: DataFrame, n_groups: int = 5, value: str = "value", ret: str = "fwd_ret", key: str = KEY, time: str = TIME) -> DataFrame:
    """time, turnover: half of the sum of changes of the long-short weights against the time before; what isn't held weighs 0.

    Times are a small table of their own: one task puts them in order.
    """
    rows = grouped(panel, n_groups, value, ret, key, time).where(F.col("bucket").isin(1, n_groups))
    size = F.count("*").over(Window.partitionBy(time, "bucket"))
    held = rows.select(time, key, (F.when(F.col("bucket") == n_groups, 1.0).otherwise(-1.0) / size).alias("w"))
    times = held.select(F.col(time).alias("_t")).distinct().withColumn("_next", F.lead("_t").over(Window.orderBy("_t")))
    gone = held.join(times, F.col(time) == F.col("_t")).where(F.col("_next").isNotNull()).select(F.col("_next").alias(time), key, (-F.col("w")).alias("w"))
    change = held.unionByName(gone).groupBy(time, key).agg(F.sum("w").alias("w"))
    return change.groupBy(time).agg((F.sum(F.abs("w")) / 2).alias("turnover"))


def cost_adjusted_returns(panel: DataFrame, fee_rate: float = 0.001, slippage: float = 0.0005, n_groups: int = 5, value: str = "value", ret: str = "fwd_ret", key: str = KEY, time: str = TIME) -> DataFrame:
    """time, gross, turnover, net: the long-short return less what its one-sided turnover costs."""
    both = long_short_returns(panel, n_groups, value, ret, key, time).join(turnover_series(panel, n_groups, value, ret, key, time), time)
    return both.withColumn("net", F.col("gross") - F.col("turnover") * (fee_rate + slippage))


def breakeven_cost(panel: DataFrame, n_groups: int = 5, value: str = "value", ret: str = "fwd_ret", key: str = KEY, time: str = TIME) -> DataFrame:
    """One row: mean gross return over mean turnover, null if nothing is turned over."""
    rows = cost_adjusted_returns(panel, 0.0, 0.0, n_groups, value, ret, key, time)
    mean = F.avg("turnover")
    return rows.agg(F.when(mean != 0, F.avg("gross") / mean).alias("breakeven_cost"), F.count("*").alias("n_periods"))


def histogram(panel: DataFrame, low: float, high: float, bins: int, value: str = "value") -> DataFrame:
    """bin, n: counts of equal bins from low to high; 0 and bins + 1 are below and above."""
    return panel.where(F.col(value).isNotNull()).groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
