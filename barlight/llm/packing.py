"""Best-fit packing of token sequences: minimum bin slack.

Each bin starts with the largest piece left; a bitset subset-sum over the lengths still available, with their counts, finds the
fullest combination for the rest of it. A combination is used as often as the counts allow before the next is sought, so that the
work hangs on the number of lengths (4096 at most), not on the number of documents: the driver sees the histogram of
lengths alone. Pieces are then numbered within their length on the cluster and look up their places.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze, map_texts, numbered

CAPACITY = 4096
#: The id that ends a document.
END = array("I", [1]).tobytes()
#: Words whose ids a worker remembers at most.
REMEMBERED = 150_000
#: Letters below this are of the Latin blocks, whose case doesn't hang on their neighbours.
LATIN = "\u0250"
#: Byte-level vocabularies write a byte that is no visible Latin-1 character as the next free character from 256 on.
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
MARKS = b".,;:!?%*#$&|)"


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    White space always ends a token of this vocabulary, so a text's ids are those of its words one after
    another, and words are remembered. ASCII letters are lower-cased first, as the vocabulary does itself; marks behind
    an ASCII letter or digit up to the word's end are split off, as the vocabulary does itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, new, split = self.known, set(), []
        for w in words:
            if w not in known:
                stem = w.rstrip(MARKS)
                if stem[-1:].isalnum() and len(stem) < len(w):
                    split.append((w, stem, w[len(stem) :]))
                    new.update(split[-1][1:])
                else:
                    new.add(w)
        for w in new:
            if w not in known:
                text = w.decode()
                # Latin letters in lower case, composed: what the vocabulary's own clean-up leaves as it is, and one token run
                if text.isalpha() and text == text.lower() and max(text) < LATIN and unicodedata.is_normalized("NFC", text):
                    ids = [t.id for t in self.model.tokenize(text if text.isascii() else w.decode("latin-1").translate(BYTE_CHARS))]
                else:
                    ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                known[w] = array("I", ids).tobytes()
        for w, stem, tail in split:
            known[w] = known[stem] + known[tail]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        # special tokens have a fixed case: their strings must not be made by lower-casing
        for at in range(0, len(texts), 64):
            part = [(t.encode() if "<|" in t else t.encode().lower()).split() for t in texts[at : at + 64]]
            self.learn(set().union(*part))
            for words in part:
                yield b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of all documents. Only documents over ``capacity`` are cut."""

    def make(texts: list[str | None]) -> tuple:
        enc = encoder(vocabulary or default_vocabulary())
        at, piece, start, length, crc = [], [], [], [], []
        for i, ids in enumerate(enc.encode([t or "" for t in texts])):
            ids += END
            for k, low in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[low : low + 4 * capacity]
                at.append(i), piece.append(k), start.append(low // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
        return at, [piece, start, length, crc]

    return map_texts(docs, [key], text, "piece int, start long, length long, ids_crc32 long", make).withColumnRenamed(key, "doc_id")


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum within ``room``; among equals, the longest lengths first."""
    bits, mask, goal, steps = 1, (1 << (room + 1)) - 1, 1 << room, []
    for l in lengths:
        if l > room or not (left := min(counts[l], room // l)):
            continue
        take = 1
        while left:
            take = min(take, left)
            steps.append((l, take, bits))
            bits |= (bits << (l * take)) & mask
            left, take = left - take, take * 2
        if bits & goal:
            break
    at, out = bits.bit_length() - 1, {}
    for l, take, before in reversed(steps):
        if not before >> at & 1:
            out[l] = out.get(l, 0) + take
            at -= l * take
    return out


def combinations(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[dict[int, int], int]]:
    """(length -> pieces of it in one bin, number of such bins) until nothing is left."""
    counts = {l: n for l, n in counts.items() if n}
    lengths = sorted(counts, reverse=True)
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        bin_ = fullest(counts, lengths, capacity - seed)
        counts[seed] += 1
        bin_[seed] = bin_.get(seed, 0) + 1
        times = min(counts[l] // m for l, m in bin_.items())
        for l, m in bin_.items():
            counts[l] -= m * times
        lengths = [l for l in lengths if counts[l]]
        yield bin_, times


def places(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, pieces of it in one bin, first bin, offset in the bin) for all ranks of all lengths."""
    out, used, first = [], dict.fromkeys(counts, 0), 0
    for bin_, times in combinations(counts, capacity):
        offset = 0
        for l in sorted(bin_, reverse=True):
            m = bin_[l]
            out.append((l, used[l], used[l] + m * times, m, first, offset))
            used[l] += m * times
            offset += l * m
        first += times
    return out


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents, each ended by the id 1, into as few sequences of at most ``capacity`` tokens as the method finds.

    Returns for each piece doc_id, piece, start, length, ids_crc32, sequence_id and offset. A null text counts as empty: one token, the
    end. Repeated rows are packed as often as they stand there; which of two equal pieces gets which place
    is open. An empty table gives no rows. Further columns are ignored.
    """
    cut = freeze(pieces(docs, vocabulary, capacity, key, text))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    table = docs.sparkSession.createDataFrame(places(counts, capacity), "l long, low long, high long, m long, first long, base long")
    ranked = numbered(cut, ["length"], ["doc_id", "piece", "ids_crc32"], F.xxhash64("doc_id", "piece"), sum(counts.values()), "rank")
    # a row for each length in each combination: bounded by the lengths, whatever the number of documents
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    inside = F.col("rank") - F.col("low")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(inside / F.col("m"))).cast("long").alias("sequence_id"), (F.col("base") + (inside % F.col("m")) * F.col("length")).alias("offset"))
