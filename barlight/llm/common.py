"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barlight.session import shared_folder

#: White space of the word rule: blank and 0x09 to 0x0D, nothing else.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def freeze(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; for narrow rows, as they are written uncompressed."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; for rows with texts."""
    path = new_table(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def new_table(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: A batch of rows ends after so many bytes.
BATCH_BYTES = 32 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches small: texts can be long, and a batch is held in a worker as a whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like those given that none of the columns has, in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def null_safe_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def numbered(df: DataFrame, group: list[str], order: list, salt: Column, rows: int, name: str, per_part: int = 20_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, whatever share of all rows a group holds.

    Rows are dealt by (group, salt bucket); a small table of counts gives each
    bucket its first number, and only the rows of one bucket are sorted together.
    ``rows`` (about all rows) sets the number of buckets. Ties in ``order`` get
    any numbers. Null groups are groups like others.
    """
    buckets = max(8, -(-rows // per_part))
    parts = df.withColumn("_b", F.pmod(salt, F.lit(buckets)).cast("int"))
    counts = parts.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_b").alias("_gb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*group, "_b").orderBy(*order)
    ranked = parts.withColumn("_rn", F.row_number().over(inside))
    on = F.col("_b") == F.col("_gb")
    for i, c in enumerate(group):
        on &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return ranked.join(first, on).withColumn(name, (F.col("_first") + F.col("_rn") - 1).cast("long")).drop("_b", "_gb", "_first", "_rn", *[f"_g{i}" for i in range(len(group))])


#: Types of the columns that a task makes, by their names in Spark.
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def map_texts(df: DataFrame, keep: list[str], text: str, made: str, make: Callable[[list[str | None]], tuple], end: Callable[[], None] | None = None) -> DataFrame:
    """Columns in ``keep``, untouched, with those in ``made`` ("name type, ...") that ``make`` gives for a batch of texts.

    ``make`` gives the row of the batch that each of its rows belongs to (None: one for each), and the columns. What is kept never
    leaves Arrow, so that large numbers beside nulls stay what they are. ``end`` is called when a task's rows are done.
    """
    small_batches(df.sparkSession)
    fields = [f.split() for f in made.split(", ")]
    kept = [f"k{i}" for i in range(len(keep))]
    types = [df.schema[c].dataType.simpleString() for c in keep]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, columns = make(b.column(len(keep)).to_pylist())
            old = [b.column(i) for i in range(len(keep))]
            if at is not None:
                rows = pa.array(at, type=pa.int32())
                old = [c.take(rows) for c in old]
            new = [c if isinstance(c, pa.Array) else pa.array(c, type=ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*old, *new], names=[*kept, *(n for n, _ in fields)])
        if end:
            end()
        # a worker serves later stages too: it keeps no buffers for them
        pa.default_memory_pool().release_unused()

    source = df.select(*[F.col(c).alias(n) for c, n in zip(keep, kept, strict=True)], F.col(text).cast("string").alias("_text"))
    out = source.mapInArrow(each, ", ".join([*(f"{n} {t}" for n, t in zip(kept, types, strict=True)), *(f"{n} {t}" for n, t in fields)]))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, kept, strict=True)], *[n for n, _ in fields])
