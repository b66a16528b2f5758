"""The research run: download, clean, compute, evaluate, report; and its incremental form.

    python -m barlight.plans.research --recordings DIR --lake DIR --symbols A,B --interval 1h --start 2024-01-01 --end 2024-02-01
"""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import factors as _catalogue  # noqa: F401  registers the factors
from ..functions.intervals import interval_ms
from ..functions.timeutil import to_utc
from ..operators import evaluate
from ..operators.medallion import silver_projection
from ..operators.registry import compute_factors, list_factors
from ..operators.validate import ContractError
from ..session import builder, require
from ..sources import refresh
from ..sources.files import PLACE, partitions, read_lake_bronze, read_lake_silver, write_gold_panel
from ..sources.layout import Lake, series_names
from ..sources.replay import Downloader
from .report import report_data, write_report


MARKET = "spot"


def get_logger(name: str = "barlight") -> logging.Logger:
    """A console logger; asking again adds no second handler."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
        log.propagate = False
    return log


@dataclass
class Run:
    recordings: str
    lake: Lake
    symbols: list[str]
    interval: str
    start: str
    end: str
    exchange: str = "replay"
    market: str = MARKET
    quarantine: bool = False
    reports: str = "reports"
    factors: list[str] = field(default_factory=lambda: [f for f in list_factors() if f != "funding_momentum"])

    @property
    def step(self) -> str:
        return f"{interval_ms(self.interval) // 1000} SECONDS"


def download(spark: SparkSession, run: Run) -> None:
    Downloader(spark, run.recordings, run.lake.bronze, run.exchange, run.market).download_all(run.symbols, run.interval, to_utc(run.start), to_utc(run.end))


def batches(spark: SparkSession, run: Run) -> list[str]:
    return sorted(p["batch"] for p in partitions(spark, run.lake.bronze, ("batch",)))


def _clean_rows(spark: SparkSession, run: Run, names: Sequence[str]) -> DataFrame:
    return silver_projection(read_lake_bronze(spark, run.lake.bronze, names), PLACE[:2])


def clean(spark: SparkSession, run: Run) -> None:
    """All of Bronze into Silver: one scan, which is checked while it is written."""
    names = batches(spark, run)
    if not names:
        raise ContractError("no rows")
    refresh.merge_silver(_clean_rows(spark, run, names), run.lake, run.quarantine)
    refresh.mark(spark, run.lake, "silver", names)


def compute(spark: SparkSession, run: Run) -> None:
    """All factors of all series in one pass."""
    names = refresh.done(spark, run.lake, "silver")
    silver = read_lake_silver(spark, run.lake)
    write_gold_panel(compute_factors(silver, {f: (f, None) for f in run.factors}, PLACE), run.lake, run.factors)
    for factor in run.factors:
        refresh.mark(spark, run.lake, f"gold/{factor}", sorted(names))


def _own(silver: DataFrame, run: Run) -> DataFrame:
    """The run's exchange, market and interval, whose series a symbol tells apart."""
    place = series_names(run.exchange, run.market, "x", run.interval)
    return silver.where((F.col("exchange") == place["exchange"]) & (F.col("market") == place["market"]) & (F.col("interval") == place["interval"]))


def panels(spark: SparkSession, run: Run, factors: Sequence[str]) -> DataFrame:
    """The run's series with forward returns and a column for each factor, in one pass."""
    silver = _own(read_lake_silver(spark, run.lake), run).withColumnRenamed("open_time_utc", "open_time")
    return compute_factors(evaluate.forward_returns(silver, run.step), {f: (f, None) for f in factors}, ("symbol",), "open_time")


def panel(spark: SparkSession, run: Run, factor: str) -> DataFrame:
    return panels(spark, run, [factor]).withColumnRenamed(factor, "value")


def assess(spark: SparkSession, run: Run) -> DataFrame:
    keys = ["symbol", "open_time", "fwd_ret"]
    return evaluate.ic_summary(panels(spark, run, run.factors).select(*keys, *run.factors).unpivot(keys, list(run.factors), "factor_name", "value"))


def report(spark: SparkSession, run: Run) -> list[str]:
    return [str(write_report(f, report_data(panel(spark, run, f), run.step), f"{run.reports}/{f}.html")) for f in run.factors]


STEPS = (download, clean, compute, assess, report)


def incremental(spark: SparkSession, run: Run) -> None:
    """Fetch what is new and bring Silver and Gold up to it, reading and writing only the time buckets that the new bars reach.

    Each download is a batch of Bronze; a log tells which batches a layer has taken up. A run that broke off between two layers is finished by the next, a
    batch taken up twice changes nothing, and a run that finds nothing new writes nothing. A factor that has never been computed lacks all batches, and so gets
    all its values.
    """
    download(spark, run)
    known = batches(spark, run)
    if pending := [b for b in known if b not in refresh.done(spark, run.lake, "silver")]:
        refresh.merge_silver(_clean_rows(spark, run, pending), run.lake, run.quarantine)
        refresh.mark(spark, run.lake, "silver", pending)
    lacking: dict[tuple[str, ...], list[str]] = {}
    for factor in run.factors:
        have = refresh.done(spark, run.lake, f"gold/{factor}")
        lacking.setdefault(tuple(b for b in known if b not in have), []).append(factor)
    for names, factors in lacking.items():
        if names:
            refresh.refresh_gold(spark, run.lake, refresh.changes(_clean_rows(spark, run, names)), factors)
            for factor in factors:
                refresh.mark(spark, run.lake, f"gold/{factor}", names)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--dry-run", action="store_true", help="name the steps and touch nothing")
    parser.add_argument("--incremental", action="store_true")
    parser.add_argument("--quarantine", action="store_true", help="set candles that break the contract aside instead of stopping")
    for name in ("recordings", "lake", "symbols", "interval", "start", "end"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--reports", default="reports")
    parser.add_argument("--exchange", default="replay")
    parser.add_argument("--market", default=MARKET)
    args, log = parser.parse_args(argv), get_logger()
    steps = (incremental,) if args.incremental else STEPS
    if args.dry_run:
        for i, step in enumerate(steps, 1):
            log.info("step %d: %s", i, step.__name__)
        return 0
    if not all((args.recordings, args.lake, args.symbols, args.interval, args.start, args.end)):
        log.error("recordings, lake, symbols, interval, start and end are needed")
        return 2
    spark = require(spark or builder().getOrCreate())
    run = Run(args.recordings, Lake(args.lake), args.symbols.split(","), args.interval, args.start, args.end, args.exchange, args.market, args.quarantine, args.reports)
    for i, step in enumerate(steps, 1):
        log.info("step %d: %s", i, step.__name__)
        step(spark, run)
    return 0


if __name__ == "__main__":
    sys.exit(main())
