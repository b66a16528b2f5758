r"""Chat transcripts as training text with a loss mask, assembled column by column.

A turn is ``[INST] role [/INST]``, a line end, the text, ``</s>`` and a line end. In texts and roles each control string gets a backslash behind its first
character, as does each that has some already, so that no control string of a text is one of the template and taking one backslash away
gives the text back. A role's own line ends and backslashes are written as ``\n`` and ``\\`` before.

Rows are put in order by ranges of conversation and turn, so that a long conversation is spread over tasks: its formatted text may be in several pieces,
whose order is that of ``piece``. In a task a batch's bytes go into one buffer: lengths of headers, texts and ends give the places of all segments,
and what stands in the columns is copied there at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# The control strings of the template.
OPEN, CLOSE, END = "[INST] ", " [/INST]\n", "</s>\n"
CONTROL, MARKED = r"([<\[])(\\*)(/?)(s>|INST\])", re.compile(r"([<\[]\\*)\\(/?(?:s>|INST\]))")
TURN = re.compile(r"\[INST\] ([^\n]*?) \[/INST\]\n(.*?)</s>\n", re.DOTALL)
LEARNT = "assistant"
#: A piece ends after so many bytes of text; so do the rows that are assembled together, but for a longer last turn.
PIECE_BYTES = 4 << 20
LOSS = "array<struct<start: long, end: long>>"


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, CONTROL, r"\1\2\\\3\4")


def plain(text: str) -> str:
    return MARKED.sub(r"\1\2", text)


def escaped_role(role: str | None) -> str:
    return escaped(pa.array([(role or "").replace("\\", "\\\\").replace("\n", "\\n")]))[0].as_py()


def plain_role(role: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", plain(role))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts without nulls, and where each begins and the last ends."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, np.uint8), offsets


def _spread(out: np.ndarray, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> None:
    """Copy segments of ``data`` to their places in ``out``, by the place of each byte."""
    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(places, sizes) + step] = data[np.repeat(begins, sizes) + step]


def assemble(ids: pa.Array, roles: pa.Array, texts: pa.Array) -> list[pa.Array]:
    """Rows of turns, those of a conversation one behind another, to a row for each conversation: id, formatted text, loss spans in bytes, number of turns."""
    texts = escaped(pc.fill_null(texts, ""))
    kinds = pc.dictionary_encode(pc.fill_null(roles, ""))
    names = kinds.dictionary.to_pylist()
    heads, head_at = _bytes(pa.array([OPEN + escaped_role(r) + CLOSE for r in names], pa.string()))
    kind = kinds.indices.to_numpy()
    data, text_at = _bytes(texts)
    end = np.frombuffer(END.encode(), dtype=np.uint8)
    sizes = np.empty((len(kind), 3), dtype=np.int64)
    sizes[:, 0], sizes[:, 1], sizes[:, 2] = np.diff(head_at)[kind], np.diff(text_at), len(end)
    ends = np.cumsum(sizes).reshape(sizes.shape)
    places = ends - sizes
    out = np.empty(int(ends[-1, -1]) if len(kind) else 0, dtype=np.uint8)
    _spread(out, heads, head_at[:-1][kind], sizes[:, 0], places[:, 0])
    _spread(out, data, text_at[:-1], sizes[:, 1], places[:, 1])
    _spread(out, end, np.zeros(len(kind), dtype=np.int64), sizes[:, 2], places[:, 2])
    # a null is an id like others
    runs = pc.run_end_encode(ids)
    last = runs.run_ends.to_numpy()
    first = np.concatenate([[0], last[:-1]]).astype(np.int64)
    begin = places[first, 0]
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(begin, len(out)).astype(np.int32)), pa.py_buffer(out))
    learnt = np.flatnonzero(np.array([n == LEARNT for n in names], dtype=bool)[kind]) if names else np.empty(0, np.int64)
    base = begin[np.searchsorted(last, learnt, side="right")]
    spans = pa.StructArray.from_arrays([pa.array(places[learnt, 1] - base), pa.array(ends[learnt, 1] - base)], ["start", "end"])
    loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(learnt, np.append(first, len(kind))), pa.int32()), spans)
    return [runs.values, formatted, loss, pa.array(last - first, pa.int64())]


def _begin_of_last(ids: pa.Array) -> int:
    """Where the last conversation of a batch begins."""
    ends = pc.run_end_encode(ids).run_ends
    return ends[-2].as_py() if len(ends) > 1 else 0


def format_chats(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key``, piece, formatted, loss (spans of the assistant's texts in ``formatted``, in bytes of UTF-8) and n_turns.

    The pieces of a conversation, in the order of ``piece``, are its formatted text; only one of over 4 MB, or one where two tasks meet, has more than one. Null and
    empty texts are empty, a null role is an empty one, a null key is a conversation like others. Turns without
    number come first, equal ones are in the order of a hash of role and text, and repeated rows are turns of their own. No rows give none. Texts
    of any length are taken whole. Further columns are ignored.
    """
    small_batches(turns.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece(rows: pa.Table) -> pa.RecordBatch:
            columns = [rows.column(i).combine_chunks() for i in range(3)]
            return pa.RecordBatch.from_arrays(assemble(*[c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in columns]), names=["k", "formatted", "loss", "n_turns"])

        held = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            while rows.num_rows:
                # as many rows as fit; the last conversation waits for what follows, if it isn't too long to
                size = np.cumsum(pc.fill_null(pc.binary_length(rows.column(2)), 0).to_numpy())
                fit = max(1, int(np.searchsorted(size, PIECE_BYTES, side="right")))
                cut = _begin_of_last(rows.column(0).combine_chunks()) if fit >= rows.num_rows else fit
                if fit >= rows.num_rows and not cut:
                    break
                yield piece(rows.slice(0, cut))
                rows = rows.slice(cut)
            held = rows if rows.num_rows else None
        if held is not None:
            yield piece(held)
        pa.default_memory_pool().release_unused()

    rows = turns.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(role).cast("string").alias("r"), F.col(text).cast("string").alias("t"))
    # texts are no keys, as the bounds of ranges are kept on the driver; equal rows are told apart, so that many of them are spread too
    keys = ["k", "o", "h", "i"]
    sorted_rows = rows.withColumns({"h": F.xxhash64("r", "t"), "i": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys).select("k", "r", "t")
    made = sorted_rows.mapInArrow(each, f"k {rows.schema['k'].dataType.simpleString()}, formatted string, loss {LOSS}, n_turns long")
    return made.select(F.col("k").alias(key), F.monotonically_increasing_id().alias("piece"), "formatted", "loss", "n_turns")


# ---- reading back


class Read:
    """What the pieces of one conversation say."""

    def __init__(self) -> None:
        self.turns, self.learnt, self.n_turns, self.loss_chars, self.chars = sha256(), sha256(), 0, 0, 0

    def piece(self, formatted: str, loss: list[dict]) -> Read:
        self.chars += len(formatted)
        for m in TURN.finditer(formatted):
            self.n_turns += 1
            self.turns.update(f"{plain_role(m[1])}\n{plain(m[2])}\n".encode())
        data = formatted.encode()
        for span in loss:
            text = plain(data[span["start"] : span["end"]].decode())
            self.loss_chars += len(text)
            self.learnt.update(text.encode())
        return self

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.learnt.hexdigest(), self.chars


NUMBERS = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
READ = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in NUMBERS.items())
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in b.columns)


def _batches(rows: Iterator[tuple], schema: pa.Schema, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of at most 1000 rows, ended early by what the column ``text`` holds."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[text] or "") if text is not None else 0
        if len(out) == 1000 or size > PIECE_BYTES:
            yield _batch(out, schema)
            out, size = [], 0
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _inside(pieces: Iterator[tuple]) -> Iterator[tuple]:
    """Each piece as it is, or what it says where it is all of a conversation that neither begins nor ends the task."""
    nothing = (None,) * len(NUMBERS)
    first, now, alone = True, None, None
    for row in pieces:
        if first or row[0] == now:
            if alone:
                yield *alone, *nothing
                alone = None
            yield *row, *nothing
        else:
            if alone:
                yield alone[0], alone[1], None, None, *Read().piece(*alone[2:]).row()
            alone = row
        first, now = False, row[0]
    if alone:
        yield *alone, *nothing


def _across(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A row for each conversation, from what has been read and from pieces in order."""
    now, read = None, None
    for key, _, formatted, loss, *told in rows:
        if read and key != now:
            yield now, *read.row()
            read = None
        if formatted is None:
            yield key, *told
        else:
            now, read = key, (read or Read()).piece(formatted, loss)
    if read:
        yield now, *read.row()


def read_back(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key`` with n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation, from its formatted pieces alone.

    A task reads the conversations that neither begin nor end it; the pieces of the others, and of those with more than one piece, are sent to where their
    conversation is read. A digest over a whole conversation can't be split: it is worked out piece by piece in order, with one piece in memory.
    """
    small_batches(chats.sparkSession)
    kind = chats.schema[key].dataType.simpleString()

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = pa.schema([("k", b.schema.field(0).type), ("piece", pa.int64()), ("formatted", pa.string()), ("loss", SPANS), *NUMBERS.items()])
            return (yield from _batches(_inside(_rows(chain([b], batches))), kept, 2))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            return (yield from _batches(_across(_rows(chain([b], batches))), pa.schema([("k", b.schema.field(0).type), *NUMBERS.items()])))

    rows = chats.select(F.col(key).alias("k"), "piece", "formatted", "loss")
    parts = rows.mapInArrow(inside, f"k {kind}, piece long, formatted string, loss {LOSS}, {READ}")
    met = parts.repartition("k").sortWithinPartitions("k", "piece")
    return met.mapInArrow(across, f"k {kind}, {READ}").withColumnRenamed("k", key)
