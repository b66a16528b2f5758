"""Training-corpus pipeline: quality rules, near-duplicate join, personal data, source mix and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm import mixing, ngram_join, packing, pii, quality
from barlight.llm.common import discard, new_table, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the forest reject go.

    Null, empty and short texts go. Rows without id and repeated rows are judged by their text like others. Without labels of both kinds the
    rules alone decide. Of the columns those of documents stay. No rows give none.
    """
    return quality.keep(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the least id stays.

    Repeated rows (same id, same text) stay once; of one id, rows with other texts are documents of their own; a row without id stays
    only where no other of its component has one. Texts without words are linked with nothing and stay. No rows give none.
    """
    return ngram_join.representatives(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by their kind; n_chars follows the text. Every row stays, also those with nulls, and a null text stays null."""
    return pii.mask(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it, rows of one id together. A null source is one like others and stands last; texts without
    words stay as often as their source is taken whole.
    """
    return mixing.repeated(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences; a null text counts as empty and holds the end mark alone. Repeated rows are packed each for itself."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: The forest, the field and the tokenizer can't be said in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each returns is written before the next reads it, and removed when that one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := new_table(spark))
            docs = spark.read.parquet(path)
            if before:
                discard(spark, before)
            before = path
    return docs
