"""Alignment of two tokenizers over the same texts.

Python tokenises and gives, for each text, the ids and the numbers of the tokens that end where one of the other side does, in Arrow arrays: the byte offsets of tokens
stay in numpy. All else is said with higher-order functions: transform, zip_with and sequence cut the ids into groups and links. For tables of tokens with their ends,
aligned() says the common ends by higher-order functions too.

A token of one side that ends together with one of the other has the same last bytes, so that one of the two is a suffix of the other:
the pairs of ids that can be linked are fewer than the bytes of both vocabularies together, however large the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from .common import freeze, small_batches, stored, unused

#: Bytes of text whose tokens are put into one Arrow batch; a longer text has one of its own.
SLICE_BYTES = 2 << 20
#: Bytes below this begin letters of the Latin blocks, up to U+023F, whose classes all versions of Unicode agree on.
LATIN = 0xC9
#: How the byte-level vocabulary's pre-tokenizer splits texts, which is the same for all vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Byte-level vocabularies write a byte that is no visible Latin-1 character as the next free character from 256 on.
BYTE_OF = {chr(b): b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
BYTE_OF |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in BYTE_OF)}
#: The piece vocabulary's sign for a blank.
BLANK = "\u2581"
#: Pairs of ids are sent to the tasks up to so many, of 20 bytes; with the public vocabularies the bound is 0.8 million. Above, they are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000


class Side:
    """What the ids of a vocabulary stand for."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.sizes = tokens, np.array([len(t) for t in tokens], dtype=np.int32)

    def cut(self, ids: list[int], text: bytes, plain: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids, and where each ends in the text; None where the tokens' bytes aren't the text's. In a ``plain`` text they are, if they are as many."""
        made = np.array(ids, dtype=np.int32)
        sizes = self.sizes[made]
        if int(sizes.sum()) != len(text) or not plain and b"".join(map(self.tokens.__getitem__, ids)) != text:
            return None
        return made, np.cumsum(sizes, dtype=np.int32)

    def at(self, ids: np.ndarray) -> np.ndarray:
        """For each byte the number of its token."""
        return np.repeat(np.arange(len(ids), dtype=np.int32), self.sizes[ids])


def among(ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The numbers of the tokens that end where one of the other side does."""
    there = np.zeros(int(ends[-1]) + 1, dtype=bool)
    there[others] = True
    return np.flatnonzero(there[ends]).astype(np.int32)


class Pair:
    """Both tokenizers.

    A byte-level vocabulary merges in the order of its ids, so that its merges can be done by either of two libraries; the faster one takes the texts of Latin letters.
    """

    def __init__(self, byte_level: str, pieces: str):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_level), SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        tokens = {i: special[i] if i in special else bytes(map(BYTE_OF.__getitem__, t)) for t, i in self.a.get_vocab().items()}
        self.latin = Encoding("byte level", pat_str=PATTERN, mergeable_ranks={t: i for i, t in tokens.items() if i not in special}, special_tokens={})
        if sum(map(self.b.is_byte, range(self.b.get_piece_size()))) != 256:
            raise ValueError("the piece vocabulary must have pieces for all bytes")
        self.sides = Side([tokens[i] for i in range(len(tokens))]), Side([self._piece(i) for i in range(self.b.get_piece_size())])

    def _piece(self, i: int) -> bytes:
        text = self.b.id_to_piece(i)
        return bytes([int(text[3:-1], 16)]) if self.b.is_byte(i) else text.replace(BLANK, " ").encode()

    def encode(self, text: str) -> tuple[np.ndarray, ...] | None:
        """Ids, ends and tokens of bytes of both sides for a blank and the text; None without text or where bytes differ."""
        made = self.tokens(text)
        return None if made is None else tuple(x for side, (ids, ends) in zip(self.sides, made, strict=True) for x in (ids, ends, side.at(ids)))

    def matched(self, text: str) -> tuple[np.ndarray, ...] | None:
        """Ids of both sides, and the numbers of the tokens that end together, for a blank and the text; None without text or where bytes differ."""
        made = self.tokens(text)
        if made is None:
            return None
        (a, a_ends), (b, b_ends) = made
        return a, b, among(a_ends, b_ends), among(b_ends, a_ends)

    def tokens(self, text: str) -> tuple[tuple[np.ndarray, np.ndarray], ...] | None:
        """Ids and ends of either side for a blank and the text; None without text or where bytes differ."""
        if not text:
            return None
        data = (spaced := " " + text).encode()
        latin = np.frombuffer(data, dtype=np.uint8).max() < LATIN
        first = self.latin.encode_ordinary(spaced) if latin else self.a.encode(spaced, add_special_tokens=False).ids
        a = self.sides[0].cut(first, data, True)
        # the piece tokenizer puts the blank before the text itself, and takes its own sign for a blank as one
        b = self.sides[1].cut(self.b.encode(text, num_threads=1), data, BLANK not in text)
        return None if a is None or b is None else (a, b)


@lru_cache(maxsize=1)
def pair(byte_level: str, pieces: str) -> Pair:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Pair(byte_level, pieces)


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


SIDES = ("a_ids", "a_ends", "a_at", "b_ids", "b_ends", "b_at")
MATCHED = ("a_ids", "b_ids", "a_last", "b_last")


def _arrays(rows: list[tuple[np.ndarray, ...] | None], columns: int) -> list[pa.Array]:
    """List arrays of the columns in the rows."""
    nothing, out = np.empty(0, dtype=np.int32), []
    for k in range(columns):
        parts = [r[k] if r else nothing for r in rows]
        offsets = np.cumsum([0, *map(len, parts)])
        out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts), pa.int32())))
    return out


def _mapped(docs: DataFrame, key: str, text: str, vocabularies: tuple[str, str] | None, columns: tuple[str, ...], make: Callable[[Pair, str], tuple[np.ndarray, ...] | None]) -> DataFrame:
    """``key`` and the arrays that ``make`` gives for each text; empty ones where it gives none."""
    small_batches(docs.sparkSession)
    ids = ArrayType(IntegerType(), False)
    schema = StructType([StructField("k", docs.schema[key].dataType), *(StructField(c, ids) for c in columns)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(*(vocabularies or default_vocabularies()))
        for b in batches:
            low, rows, size, keys = 0, [], 0, b.column(0)
            for i, t in enumerate(b.column(1)):
                t = t.as_py() or ""
                rows.append(make(both, t))
                size += len(t)
                if size > SLICE_BYTES or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([keys.slice(low, len(rows)), *_arrays(rows, len(columns))], names=["k", *columns])
                    low, rows, size = i + 1, [], 0
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(each, schema).withColumnRenamed("k", key)


def tokenised(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """``key`` and the arrays a_ids, a_ends, a_at, b_ids, b_ends, b_at; the arrays are empty without text, or where a tokenizer doesn't keep the text's bytes."""
    return _mapped(docs, key, text, vocabularies, SIDES, Pair.encode)


def matched(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """``key`` and the arrays a_ids, b_ids, a_last, b_last that aligned() gives for tokenised(), with the common ends found where the tokens are made: nothing is handed over byte by byte."""
    return _mapped(docs, key, text, vocabularies, MATCHED, Pair.matched)


# ---- groups and links


def aligned(tokens: DataFrame) -> DataFrame:
    """The rows with the arrays a_last and b_last: for each end that both sides have, the numbers of the tokens that end there.

    A group lies between two such ends. No ends give no groups.
    """
    common = unused(tokens.columns, "common")[0]
    there = lambda at: F.transform(common, lambda end: F.get(at, end - 1))
    return tokens.withColumn(common, F.array_intersect("a_ends", "b_ends")).withColumns({"a_last": there("a_at"), "b_last": there("b_at")}).drop(common)


def _first(side: str, k: Column) -> Column:
    """The number of the k-th group's first token."""
    return F.coalesce(F.get(side, k - 1) + 1, F.lit(0))


def _cut(ids: Column, side: str, k: Column) -> Column:
    # one by one: cutting a slice out goes through the whole array, which is too much for each group
    return F.transform(F.sequence(_first(side, k), F.get(side, k)), lambda i: F.get(ids, i))


def groups() -> Column:
    """The ids a and b between two common ends, for rows of aligned()."""
    return F.transform("a_last", lambda _, k: F.struct(_cut(F.col("a_ids"), "a_last", k).alias("a"), _cut(F.col("b_ids"), "b_last", k).alias("b")))


def links() -> Column:
    """The ids of a and b that end at a common end, for rows of aligned()."""
    return F.zip_with("a_last", "b_last", lambda x, y: F.struct(F.get("a_ids", x).alias("a"), F.get("b_ids", y).alias("b")))


def packed_links() -> Column:
    """The links as one number each: that of a times HALF, and that of b."""
    return F.zip_with("a_last", "b_last", lambda x, y: F.get("a_ids", x).cast("long") * HALF + F.get("b_ids", y))


def told(a: Column, b: Column) -> Column:
    """Groups as text, for rows of aligned(): ids of a and of b, joined by commas, with a bar between, and semicolons between groups. ``a``, ``b``: the ids as text.

    ``both``, a column of the rows, has the sums of a_last and b_last: most groups have one token on either side, which is told by one difference.
    """
    last = lambda x, side, k: F.get(x, F.get(side, k))
    single = lambda side, k: F.get(side, k) == _first(side, k)
    ids = lambda x, side, k: F.when(single(side, k), last(x, side, k)).otherwise(F.concat_ws(",", _cut(x, side, k)))
    each = lambda s, k: s - F.get("both", k - 1) == 2
    pair = lambda s, k: F.when(each(s, k), F.concat(last(a, "a_last", k), F.lit("|"), last(b, "b_last", k))).otherwise(F.concat(ids(a, "a_last", k), F.lit("|"), ids(b, "b_last", k)))
    return F.array_join(F.transform("both", pair), ";")


def one_to_one() -> Column:
    """How many groups have one token on either side, for rows of aligned()."""
    one = lambda side, k: F.get(side, k) == _first(side, k)
    each = F.transform("a_last", lambda _, k: (one("a_last", k) & one("b_last", k)).cast("long"))
    return F.aggregate(each, F.lit(0).cast("long"), lambda n, x: n + x)


def pair_counts(linked: DataFrame) -> DataFrame:
    """a, b, count and whether no other a has a higher count for this b, over the rows' arrays ``links``."""
    counts = linked.select(F.explode("links").alias("l")).groupBy("l").agg(F.count("*").alias("count"))
    split = counts.select(*_halves(F.col("l")), "count")
    # as many rows as there are possible pairs for an id at most
    return split.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


#: Two ids in one number.
HALF = 1 << 31


def _halves(link: Column) -> list[Column]:
    return [F.expr("l div {}".format(HALF)).cast("int").alias("a"), (link % HALF).cast("int").alias("b")]


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """How the tokens of two tokenizers lie in each text, and how well the links agree with those of the whole corpus.

    Returns ``key``, n_a, n_b, n_groups, n_links, n_best (links whose pair is the commonest of its b), count_sum (over links, how often their pair is linked
    corpus-wide) and groups_sha256. Null and empty texts, and texts whose bytes a tokenizer changes, give zeros and an empty text; texts of any length are taken
    whole. Rows are rows of their own where ids repeat or are null. An empty table gives no rows. Further columns are ignored.

    The links are written once, as counting and looking up both read them; only counts of pairs and of rows are shuffled.
    """
    rows = matched(docs, key, text, vocabularies)
    # turned into text as a whole, as a column of its own
    rows = rows.withColumns({"a_text": F.col("a_ids").cast("array<string>"), "b_text": F.col("b_ids").cast("array<string>"), "both": F.zip_with("a_last", "b_last", lambda x, y: x + y)})
    n, some = F.size("a_last").cast("long"), F.size("a_ids") > 0
    sizes = [F.size("a_ids").cast("long").alias("n_a"), F.size("b_ids").cast("long").alias("n_b"), n.alias("n_groups")]
    table = stored(rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), *sizes, F.when(some, F.sha2(told(F.col("a_text"), F.col("b_text")), 256)).otherwise("").alias("groups_sha256"), packed_links().alias("links")))
    pairs = freeze(pair_counts(table))
    side = pairs.select((F.col("a").cast("long") * HALF + F.col("b")).alias("l"), "count", "best")
    side = F.broadcast(side) if pairs.count() <= BROADCAST_PAIRS else side
    found = table.select("row", F.explode("links").alias("l")).join(side, "l")
    sums = found.groupBy("row").agg(F.count("*").alias("n_links"), F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = table.drop("links").join(sums, "row", "left")
    return out.select(F.col("k").alias(key), "n_a", "n_b", "n_groups", *map(zero, ("n_links", "n_best", "count_sum")), "groups_sha256")
