"""Readers and writers of the layers and of CSV and JSON files."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from hashlib import sha256
from pathlib import Path
from typing import Any
from urllib.parse import unquote
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.medallion import silver_projection
from ..operators.schemas import BRONZE_KLINE, SERIES, SILVER_KLINE
from ..operators.validate import ContractError, contract_rules, judged
from .layout import Lake

PLACE = ("exchange", "market", "symbol", "interval")
BUCKET = "bucket"
BRONZE_PARTS = ("batch", *PLACE)
SILVER_PARTS = (*PLACE, BUCKET)
GOLD_PARTS = ("factor_name", "params", *SILVER_PARTS)


def _read(spark: SparkSession, path: str, schema: StructType | None, kind: str = "parquet", **options: str) -> DataFrame:
    try:
        reader = spark.read.options(**options)
        return (reader.schema(schema) if schema else reader).format(kind).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise


def _write(df: DataFrame, path: str, parts: Sequence[str], mode: str = "overwrite") -> None:
    """Only the partitions that the rows touch are replaced."""
    writer = df.write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)


def write_bronze_klines(df: DataFrame, path: str, parts: Sequence[str] = ()) -> None:
    _write(df, path, parts)


def read_bronze_klines(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return _read(spark, path, BRONZE_KLINE, kind)


def read_silver_klines(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, SILVER_KLINE)


def write_silver_klines(silver: DataFrame, path: str, parts: Sequence[str] = ()) -> None:
    _write(silver.sortWithinPartitions("symbol", "interval", "open_time_utc"), path, parts)


def stage(rows: DataFrame, path: str, parts: Sequence[str]) -> dict[str, int]:
    """Write candles to a folder of their own, good and broken ones apart (``good=true`` and ``good=false``), and count them in the same pass: rows, and how many break which rule first."""
    seen, rules = Observation(), contract_rules()
    counted = judged(rows, parts).observe(seen, F.count("*").alias("rows"), *[F.count(F.when(F.col("broken") == r, 1)).alias(f"r{i}") for i, r in enumerate(rules)])
    marked = counted.withColumns({"good": F.col("broken").isNull(), "staging": F.lit(uuid4().hex)})
    # as a whole, so that a mark of success is written
    marked.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd").partitionBy("good").parquet(path)
    told = seen.get
    return {"rows": told["rows"]} | {r: told[f"r{i}"] for i, r in enumerate(rules) if told[f"r{i}"]}


def discard(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def build_silver(spark: SparkSession, bronze_path: str, silver_path: str, parts: Sequence[str] = ()) -> DataFrame:
    """Read Bronze, check and clean it, write Silver, give back what was written.

    Bronze is read once: it is checked while it is written beside Silver, and comes into its place from there only if it keeps the contract.
    """
    bronze, staged = read_bronze_klines(spark, bronze_path), f"{silver_path.rstrip('/')}_staged"
    told = stage(silver_projection(bronze), staged, (*SERIES, "open_time_utc"))
    try:
        if not told["rows"]:
            raise ContractError("no rows")
        for rule in contract_rules():
            if rule in told:
                raise ContractError(rule, told[rule])
        write_silver_klines(spark.read.schema(SILVER_KLINE).parquet(f"{staged}/good=true"), silver_path, parts)
    finally:
        discard(spark, staged)
    return read_silver_klines(spark, silver_path)


def params_tag(params: dict[str, Any] | None) -> str:
    """A short name of parameters, so that factors of one family with others don't overwrite each other."""
    return "default" if not params else sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:12]


def in_buckets(df: DataFrame, lake: Lake) -> DataFrame:
    return df.withColumn(BUCKET, F.date_format("open_time_utc", lake.bucket))


def read_lake_bronze(spark: SparkSession, path: str, batches: Sequence[str] | None = None) -> DataFrame:
    """Bronze with exchange, market and batch; of the given batches alone no other folder is looked into."""
    schema = StructType([*BRONZE_KLINE.fields, *(StructField(p, StringType()) for p in BRONZE_PARTS[:3])])
    if batches is None:
        return _read(spark, path, schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*[f"{path.rstrip('/')}/batch={b}" for b in batches])


def read_lake_silver(spark: SparkSession, lake: Lake) -> DataFrame:
    """Silver with its partition columns."""
    return _read(spark, lake.silver, StructType([*SILVER_KLINE.fields, *(StructField(p, StringType()) for p in (*PLACE[:2], BUCKET))]))


def write_lake_silver(silver: DataFrame, lake: Lake) -> None:
    """Rows with exchange and market; the buckets of series that they touch are replaced."""
    rows = in_buckets(silver, lake)
    _write(rows.repartition(*SILVER_PARTS).sortWithinPartitions(*SILVER_PARTS, "open_time_utc"), lake.silver, SILVER_PARTS)


def save_bucketed_silver(silver: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> None:
    """Silver as a table of the catalogue, dealt by exchange, market, symbol and interval: windows over these series read it without a shuffle."""
    keys = [*PLACE, "open_time_utc"]
    dealt = silver.repartition(buckets, *PLACE).sortWithinPartitions(*keys)
    writer = dealt.write.mode("overwrite").format("parquet").option("compression", "zstd")
    (writer.option("path", path) if path else writer).bucketBy(buckets, *PLACE).sortBy(*keys).saveAsTable(table)


def partitions(spark: SparkSession, path: str, columns: Sequence[str], **wanted: str) -> list[dict[str, str]]:
    """The values of a table's first partition columns, those in ``wanted`` as given, from the names of its folders alone."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    literal = lambda v: re.sub(r"([\\{}\[\]*?,])", r"\\\1", escape(v))
    pattern = fs_path("/".join([path.rstrip("/"), *(f"{c}={literal(wanted[c]) if c in wanted else '*'}" for c in columns)]))
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    places = [str(s.getPath().toString()).split("/")[-len(columns) :] for s in found]
    return [{c: unquote(part.split("=", 1)[1]) for c, part in zip(columns, place, strict=True)} for place in places]


def write_gold_factor(values: DataFrame, lake: Lake, *, factor_name: str, exchange: str, market: str = "spot", params: dict[str, Any] | None = None) -> str:
    """Values of many series (symbol, interval, open_time_utc, value) under the factor's name and parameters."""
    rows = values.select("open_time_utc", "value", "symbol", "interval").withColumns({"factor_name": F.lit(factor_name), "params": F.lit(params_tag(params)), "exchange": F.lit(exchange), "market": F.lit(market)})
    return _write_gold(rows, lake)


def _write_gold(rows: DataFrame, lake: Lake) -> str:
    """The buckets that the rows touch are replaced; a series' bucket of a factor is one file."""
    _write(in_buckets(rows, lake).repartition(*GOLD_PARTS).sortWithinPartitions(*GOLD_PARTS, "open_time_utc"), lake.gold, GOLD_PARTS)
    return lake.gold


def write_gold_panel(wide: DataFrame, lake: Lake, factors: Sequence[str]) -> str:
    """Several factors with default parameters, a column each beside exchange, market, symbol, interval and time, in one write."""
    keys = [*PLACE, "open_time_utc"]
    long = wide.select(*keys, *factors).unpivot(keys, list(factors), "factor_name", "value")
    return _write_gold(long.withColumn("params", F.lit(params_tag(None))), lake)


def read_gold(spark: SparkSession, lake: Lake) -> DataFrame | None:
    """All factors' values with their partition columns, or None without a table."""
    schema = StructType.fromDDL("open_time_utc timestamp, value double, " + ", ".join(f"{p} string" for p in GOLD_PARTS))
    try:
        return _read(spark, lake.gold, schema)
    except FileNotFoundError:
        return None


def read_gold_factor(spark: SparkSession, lake: Lake, *, factor_name: str, symbol: str | None = None, interval: str | None = None, params: dict[str, Any] | None = None) -> DataFrame | None:
    """The factor's values, or None if there are none. Only its partitions are read."""
    gold = read_gold(spark, lake)
    if gold is None:
        return None
    rows = gold.where((F.col("factor_name") == factor_name) & (F.col("params") == params_tag(params)))
    for column, wanted in (("symbol", symbol), ("interval", interval)):
        rows = rows.where(F.col(column) == wanted) if wanted else rows
    return None if rows.isEmpty() else rows


def list_gold_factors(spark: SparkSession, lake: Lake, *, symbol: str | None = None, interval: str | None = None) -> list[str]:
    """Sorted names; empty without a table. No file is opened."""
    wanted = {k: v for k, v in (("symbol", symbol), ("interval", interval)) if v}
    columns = GOLD_PARTS[: max((GOLD_PARTS.index(k) + 1 for k in wanted), default=1)]
    return sorted({p["factor_name"] for p in partitions(spark, lake.gold, columns, **wanted)})


def import_nanosecond_parquet(spark: SparkSession, path: str, times: Sequence[str]) -> DataFrame:
    """Parquet whose times are nanoseconds, as pandas writes them: read as numbers, cut to microseconds."""
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    df = spark.read.parquet(path)
    return df.withColumns({t: F.timestamp_micros(F.floor(F.col(t) / 1000)) for t in times})


def read_csv(spark: SparkSession, path: str, schema: StructType | str, **options: str) -> DataFrame:
    """UTF-8 with a header; options override."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return _read(spark, path, wanted, "csv", **({"header": "true", "encoding": "UTF-8"} | options))


def write_csv(df: DataFrame, path: str, single: bool = False, **options: str) -> None:
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite").options(**({"header": "true", "encoding": "UTF-8"} | options)).csv(path)


def read_json_document(path: str | Path) -> Any:
    """A small document for the driver, as settings are."""
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_json_document(data: Any, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
