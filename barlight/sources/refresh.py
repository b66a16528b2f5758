"""Refresh of Silver and Gold after changes: only the time buckets that a change can reach are read and written.

A factor's value hangs on a bounded number of bars before it. So a bar that changes can change the values of that many bars behind it, and these
need as many bars before them. How many bars stand in each bucket is told by the files' footers; from this small table come the buckets to be written
and those to be read.
"""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.registry import compute_factors, lookback
from ..operators.schemas import SILVER_COLUMNS
from ..operators.validate import ContractError, contract_rules
from ..session import shared_folder
from .files import BUCKET, PLACE, SILVER_PARTS, _write, in_buckets, partitions, read_lake_silver, stage, write_gold_panel, write_lake_silver
from .layout import Lake

#: Up to so many buckets are named one by one, which prunes the scan to them; beyond, the scan is pruned by least and greatest bucket and joined.
NAMED = 5_000
KEYS = (*PLACE, "open_time_utc")


def in_place(df: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of a table in these partitions (exchange, market, symbol, interval, bucket). Other partitions aren't read."""
    name = lambda: F.concat_ws("/", *SILVER_PARTS)  # noqa: E731  no part has a slash
    few = [r[0] for r in parts.select(name()).distinct().limit(NAMED + 1).collect()]
    if len(few) <= NAMED:
        return df.where(name().isin(few))
    least, most = parts.agg(F.min(BUCKET), F.max(BUCKET)).first()
    return df.where(F.col(BUCKET).between(least, most)).join(parts.select(*SILVER_PARTS).distinct(), list(SILVER_PARTS), "left_semi")


def changes(rows: DataFrame) -> DataFrame:
    """exchange, market, symbol and interval of the series that have rows here, with the first and last of their times."""
    return rows.groupBy(*PLACE).agg(F.min("open_time_utc").alias("changed_from"), F.max("open_time_utc").alias("changed_to"))


def bars_in_buckets(silver: DataFrame, changed: DataFrame) -> DataFrame:
    """How many bars each bucket of the changed series has. Counting reads no column."""
    symbols = [r[0] for r in changed.select("symbol").distinct().limit(NAMED + 1).collect()]
    near = silver.where(F.col("symbol").isin(symbols)) if len(symbols) <= NAMED else silver
    return near.groupBy(*SILVER_PARTS).agg(F.count("*").alias("n"))


def reached(counts: DataFrame, changed: DataFrame, bars: float, lake: Lake) -> DataFrame:
    """The buckets of changed series that have to be read, with ``write`` for those whose values may change.

    Written are those from the first changed bar's to the one where ``bars`` rows stand between the last changed bar's bucket and its end; read are also those
    before, until they have ``bars`` rows. Without bound all before are read and all behind are written.
    """
    name = lambda c: F.date_format(c, lake.bucket)
    span = changed.select(*PLACE, name("changed_from").alias("_low"), name("changed_to").alias("_high"))
    series = Window.partitionBy(*PLACE)
    upto = series.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0)
    here = F.col(BUCKET)
    # rows up to and with each bucket, before the first changed one, and up to the last changed one
    rows = counts.join(span, list(PLACE)).withColumns({"_upto": F.sum("n").over(upto), "_before": F.coalesce(F.sum(F.when(here < F.col("_low"), F.col("n"))).over(series), F.lit(0)), "_within": F.coalesce(F.sum(F.when(here <= F.col("_high"), F.col("n"))).over(series), F.lit(0))})
    bound = F.lit(float(bars))
    write = (here >= F.col("_low")) & ((here <= F.col("_high")) | (F.col("_upto") - F.col("n") - F.col("_within") < bound))
    read = write | ((here < F.col("_low")) & (F.col("_before") - F.col("_upto") < bound))
    return rows.withColumn("write", write).where(read).select(*SILVER_PARTS, "write")


# ---- Silver


def _staged(lake: Lake) -> str:
    return f"{lake.silver}_staged"


def _finish(spark: SparkSession, lake: Lake, quarantine: bool) -> None:
    """Put what is staged in its place, if it has been staged as a whole; done again, it changes nothing.

    Good rows replace their buckets of Silver. Broken rows go to the quarantine table; without one nothing is replaced and the first broken rule is raised.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(_staged(lake))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path(folder, "_SUCCESS")):
        rows = spark.read.parquet(_staged(lake)) if {p["good"] for p in partitions(spark, _staged(lake), ("good",))} else None
        if rows is not None:
            broken = {r["broken"]: r["count"] for r in rows.where("good = 'false'").groupBy("broken").count().collect()}
            if broken and not quarantine:
                files.delete(folder, True)
                rule = next(r for r in contract_rules() if r in broken)
                raise ContractError(rule, broken[rule])
            if broken:
                _write(rows.where("good = 'false'").drop("good"), lake.quarantine, ("staging",))
            good = rows.where("good = 'true'").drop("good", "broken", "staging", BUCKET)
            if len(broken) == 0 or not good.isEmpty():
                write_lake_silver(good, lake)
    files.delete(folder, True)


def merge_silver(arrived: DataFrame, lake: Lake, quarantine: bool = False) -> dict[str, int]:
    """Merge clean candles with exchange and market into Silver: new rows stand for old ones of the same bar, and only the buckets that they fall into are read and rewritten.

    All is first written beside Silver, where the contract is checked in the same pass, and put in its place from there: a merge that broke off is finished by
    the next, and one that breaks the contract changes nothing, unless ``quarantine`` sets the broken rows aside. Without rows nothing is
    written. A repeated merge changes nothing. Gives the number of rows written and of those that break each rule.
    """
    spark = arrived.sparkSession
    _finish(spark, lake, quarantine)
    # rows that are alike in all columns are one
    batch = in_buckets(arrived.select(*SILVER_COLUMNS, *PLACE[:2]).distinct(), lake)
    parts = frozen(batch.select(*SILVER_PARTS).distinct())
    if parts.isEmpty():
        return {"rows": 0}
    merged = batch
    try:
        old = in_place(read_lake_silver(spark, lake), parts)
        merged = old.join(batch.select(*KEYS), list(KEYS), "left_anti").unionByName(batch)
    except FileNotFoundError:
        pass
    told = stage(merged, _staged(lake), SILVER_PARTS)
    _finish(spark, lake, quarantine)
    return told


def frozen(df: DataFrame) -> DataFrame:
    """A small table that several jobs read, written once to the folder for checkpoints."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# ---- Gold


def refresh_gold(spark: SparkSession, lake: Lake, changed: DataFrame, factors: Sequence[str]) -> None:
    """Work out the factors anew, with default parameters, where the changed bars (see changes()) reach, and replace these buckets of Gold.

    Gold isn't read, so a refresh that broke off is done again as a whole. The least that all factors look back is worked out from their windows; a factor whose windows
    have no bound is worked out over whole series.
    """
    silver = read_lake_silver(spark, lake)
    bars = lookback({f: (f, None) for f in factors}, silver)
    parts = frozen(reached(bars_in_buckets(silver, changed), changed, bars, lake))
    rows = in_place(silver, parts)
    values = compute_factors(rows, {f: (f, None) for f in factors}, PLACE)
    touched = values.join(F.broadcast(parts.where("write")) if parts.limit(NAMED + 1).count() <= NAMED else parts.where("write"), list(SILVER_PARTS), "left_semi")
    write_gold_panel(touched, lake, list(factors))


# ---- which batches a layer has


def done(spark: SparkSession, lake: Lake, layer: str) -> set[str]:
    """The batches of Bronze that a layer has taken up."""
    try:
        rows = spark.read.schema("layer string, batch string").parquet(lake.log).where(F.col("layer") == layer).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return set()
        raise
    return {r["batch"] for r in rows}


def mark(spark: SparkSession, lake: Lake, layer: str, batches: Sequence[str]) -> None:
    if batches:
        spark.createDataFrame([(layer, b) for b in batches], "layer string, batch string").coalesce(1).write.mode("append").parquet(lake.log)
