"""Substring deduplication by content-defined chunking with a gear rolling hash.

A boundary follows each byte at which the hash of the bytes up to it has its leading bits clear and no other such byte stands close
before it. Both depend on nearby bytes alone, so text that is put in or taken out moves no boundary further on.
White space counts as one blank. Chunks are told apart by a 64-bit digest; one that several documents have is kept in the first of them.

The texts are cut twice. The first pass sends out digests and ids alone and leaves a table of the digests that several documents
have; the second meets that table and keeps the places of those chunks only. Neither pass stores the chunks of all texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_texts, small_batches, stored, unused

#: Random values of the bytes, from a seed. They have 16 bits, so that the hash covers 16 bytes: each byte shifts older ones one bit further out.
GEAR = np.random.default_rng(17).integers(0, 1 << 16, 256, dtype=np.uint16)
#: A byte in 2**BITS is a candidate; one counts if the candidate before it is at least LEAST bytes away.
BITS, LEAST = 5, 16
#: Longer chunks, as in text of one word again and again, are cut every so many bytes. A prime: such cuts soon fall on every place of a short period.
MOST = 127
#: Neighbouring repeated chunks must hold so many bytes, about what is sure to be seen of fifty words and more than a common line gives,
#: or so many words: fifty words of one or two letters hold fewer bytes.
RUN_BYTES, RUN_WORDS = 120, 16


def boundaries(data: bytes) -> np.ndarray:
    """Ends of the chunks, the text's own end last."""
    if not data:
        return np.empty(0, dtype=np.int64)
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    span = 1
    while span < 16:  # sums over 1, 2, 4 ... bytes: each older half is shifted by its length
        h[span:] += h[:-span].copy() << np.uint16(span)
        span *= 2
    found = np.flatnonzero(h >> np.uint16(16 - BITS) == 0)
    if len(found):
        found = found[np.diff(found, prepend=-LEAST) >= LEAST]
    ends = found + 1
    ends = ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))
    starts = np.concatenate([[0], ends[:-1]])
    extra = (ends - starts - 1) // MOST  # further cuts in each long chunk
    if extra.any():
        first = np.repeat(np.cumsum(extra) - extra, extra)
        ends = np.sort(np.concatenate([ends, np.repeat(starts, extra) + MOST * (np.arange(len(first)) - first + 1)]))
    return ends


def canonical(data: bytes) -> tuple[bytes, np.ndarray]:
    """The bytes with each run of white space as one blank, and where each of them stood: passages are often set anew."""
    a = np.frombuffer(data, dtype=np.uint8)
    white = (a == 32) | ((a >= 9) & (a <= 13))
    keep = ~white
    keep[1:] |= ~white[:-1]
    keep[:1] = True
    return np.where(white, np.uint8(32), a)[keep].tobytes(), np.flatnonzero(keep)


def digests(data: bytes, ends: np.ndarray) -> np.ndarray:
    """A 64-bit number for each chunk. A false passage takes several neighbouring chunks that meet others by chance."""
    starts = [0, *ends[:-1].tolist()]
    return np.array([xxhash.xxh3_64_intdigest(data[x:y]) for x, y in zip(starts, ends.tolist(), strict=True)], dtype=np.uint64).view(np.int64)


def encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, t (hash of the text) and text of the rows with an id."""
    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), text_hash(text).alias("t"), F.col(text).cast("string").alias("text"))


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def chunks(named: DataFrame) -> DataFrame:
    """doc_id, t, k (number of the chunk), start, end (code points), size (bytes), words (begun in it) and digest of all chunks."""

    def make(texts: list[str | None]) -> tuple:
        rows, parts = [], []
        for i, data in enumerate(map(encoded, texts)):
            if not data:
                continue
            plain, place = canonical(data)
            ends = boundaries(plain)
            starts = np.concatenate([[0], ends[:-1]])
            low, high = place[starts], place[ends - 1] + 1
            if len(data) != len(texts[i]):  # bytes that begin a character
                points = np.concatenate([[0], np.cumsum(np.frombuffer(data, dtype=np.uint8) & 0xC0 != 0x80)])
                low, high = points[low], points[high]
            words = np.add.reduceat(np.frombuffer(plain, dtype=np.uint8) == 32, starts)
            rows.append(np.full(len(ends), i))
            parts.append((np.arange(len(ends)), low, high, ends - starts, words, digests(plain, ends)))
        if not rows:
            return [], [[]] * 6
        return np.concatenate(rows), [np.concatenate(c).astype(np.int64 if k == 5 else np.int32) for k, c in enumerate(zip(*parts, strict=True))]

    return map_texts(named, ["doc_id", "t"], "text", "k int, start int, end int, size int, words int, digest long", make)


def shared_digests(named: DataFrame) -> DataFrame:
    """digest and first_doc_id of the chunks that documents of several ids have; a digest that a document repeats leaves its task once."""

    def make(texts: list[str | None]) -> tuple:
        rows, parts = [], []
        for i, data in enumerate(map(encoded, texts)):
            if data:
                plain, _ = canonical(data)
                parts.append(np.unique(digests(plain, boundaries(plain))))
                rows.append(np.full(len(parts[-1]), i))
        return (np.concatenate(rows), [np.concatenate(parts)]) if rows else ([], [[]])

    seen = map_texts(named, ["doc_id"], "text", "digest long", make)
    ends = seen.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"))
    return ends.where(F.col("first_doc_id") < F.col("last")).select("digest", "first_doc_id")


def _passages(docs: DataFrame, run_bytes: int, run_words: int, key: str, text: str) -> DataFrame:
    named = _named(docs, key, text)
    # a table of its own, so that the join below has two plain shuffles, which Spark can split where one chunk is common
    shared = stored(shared_digests(named))
    found = chunks(named).join(shared, "digest").drop("digest").withColumn("kept", F.col("doc_id") == F.col("first_doc_id"))
    doc = Window.partitionBy("doc_id", "t").orderBy("k")
    runs = found.withColumn("run", F.col("k") - F.dense_rank().over(doc))
    # copies of a row stand side by side and count once
    every = Window.partitionBy("doc_id", "t", "run")
    runs = runs.dropDuplicates(["doc_id", "t", "k"]).withColumn("whole", F.sum("size").over(every)).withColumn("counted", F.sum("words").over(every))
    runs = runs.where((F.col("whole") >= run_bytes) | (F.col("counted") >= run_words))
    part = Window.partitionBy("doc_id", "t", "run", "kept").orderBy("k")
    parts = runs.withColumn("part", F.col("k") - F.row_number().over(part))
    long = lambda x: x.cast("long")
    return parts.groupBy("doc_id", "t", "run", "kept", "part").agg(long(F.min("start")).alias("start"), long(F.max("end")).alias("end"), F.sum("size").alias("n_bytes"), F.min("first_doc_id").alias("first_doc_id"))


def repeats(docs: DataFrame, run_bytes: int = RUN_BYTES, run_words: int = RUN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages that several documents share: doc_id, start, end (code points), n_bytes, first_doc_id and kept.

    A row is a longest stretch of neighbouring chunks of a document that other documents have too, with all in or all not in their first
    document (the least id), which keeps them: kept tells. Stretches of both kinds count together
    towards ``run_bytes`` and ``run_words``, of which one must be met. A passage that only one document repeats is none. Rows of one id count as one document; equal ones give one row
    for each passage. A null or empty text and a row with a null id has none. An empty table gives no rows. Further columns are ignored.
    """
    return _passages(docs, run_bytes, run_words, key, text).select("doc_id", "start", "end", "n_bytes", "first_doc_id", "kept")


def dedupe(docs: DataFrame, run_bytes: int = RUN_BYTES, run_words: int = RUN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same rows and columns, without the passages that another document keeps.

    Rows of one id count as one document, and each loses what its own text repeats of others. Rows with a null id and null or empty
    texts stay as they are. An empty table gives no rows. Further columns may have any names.
    """
    small_batches(docs.sparkSession)
    i, t, gone = unused(docs.columns, "i", "t", "gone")
    spans = _passages(docs, run_bytes, run_words, key, text).where(~F.col("kept")).groupBy(F.col("doc_id").alias(i), F.col("t").alias(t)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(gone))

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, gone in zip(texts, spans, strict=True):
            at, left = 0, []
            for s in gone if gone is not None and t else ():
                left.append(t[at : s["start"]])
                at = s["end"]
            out.append(t if not t else "".join([*left, t[at:]]))
        return pd.Series(out, dtype=object)

    on = (F.col(key).cast("long") == F.col(i)) & (text_hash(text) == F.col(t))
    return docs.join(spans, on, "left").withColumn(text, without(F.col(text), F.col(gone))).select(*docs.columns)
