"""Recorded messages as a data source of Spark: ``spark.read.format("recorded")``.

Options: ``root``; ``kind`` (klines, trades or funding); ``symbol``; for klines ``interval``. Gives symbol, interval, at (the message's time in milliseconds) and value (the
message). Files whose name begins with a day, as 2024-01-31, hold the messages of that day: those that a filter on ``at`` leaves no message of aren't
opened. Each file is read by a task of its own, line by line.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from math import inf

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.identifiers import segment
from ..functions.intervals import canonical_interval
from ..functions.timeutil import to_unix_ms

KINDS = ("klines", "trades", "funding")
DAY = re.compile(r"(\d{4}-\d{2}-\d{2})(?!\d)")


@dataclass
class RecordedFile(InputPartition):
    path: str

    def __hash__(self) -> int:
        return hash(self.path)


def time_of(kind: str, line: str) -> int | None:
    """A message's time in milliseconds; None where it can't be read."""
    try:
        message = json.loads(line)
        if kind == "klines":
            return int(message[0])
        at = message["timestamp"]
        return to_unix_ms(datetime.fromisoformat(at)) if isinstance(at, str) else int(at)
    except (ValueError, TypeError, KeyError, IndexError, OverflowError):
        return None


class RecordedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.kind = options["root"].rstrip("/"), options["kind"]
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}: {self.kind!r}")
        self.symbol = segment(options["symbol"], field="symbol", case="upper")
        self.interval = canonical_interval(segment(options["interval"], field="interval")) if self.kind == "klines" else None
        self.low, self.high = -inf, inf  # the messages asked for: low <= at < high

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("at",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            # all are asked again of the rows
            yield f

    def _near(self, name: str) -> bool:
        """Whether a file can hold messages asked for."""
        if not (day := DAY.match(name)):
            return True
        begin = datetime.fromisoformat(day[1]).replace(tzinfo=UTC)
        return to_unix_ms(begin) < self.high and to_unix_ms(begin + timedelta(days=1)) > self.low

    def _folder(self) -> str:
        return "/".join([self.root, self.kind, self.symbol, *([self.interval] if self.interval else [])])

    def partitions(self) -> list[RecordedFile]:
        from pyarrow.fs import FileSelector, FileType

        files, path = file_system(self._folder())
        found = files.get_file_info(FileSelector(path))
        return [RecordedFile(f"{self._folder()}/{f.base_name}") for f in sorted(found, key=lambda f: f.base_name) if f.type == FileType.File and f.base_name[0] not in "._" and self._near(f.base_name)]

    def read(self, partition: RecordedFile) -> Iterator[tuple]:
        files, path = file_system(partition.path)
        with files.open_input_stream(path) as stream:
            for line in _lines(stream):
                at = time_of(self.kind, line)
                if at is None:
                    # stands where it is found by who asks, to be told as broken
                    at = 0 if self.low == -inf else int(self.low)
                if self.low <= at < self.high:
                    yield self.symbol, self.interval, at, line


def _lines(stream) -> Iterator[str]:
    """Lines of a stream of bytes that aren't empty, with a part of the file in memory."""
    rest = b""
    while part := stream.read(1 << 20):
        *whole, rest = (rest + part).split(b"\n")
        yield from (line.decode() for line in whole if line.strip())
    if rest.strip():
        yield rest.decode()


def file_system(uri: str):
    """The file system of a place and the path in it. Places that Hadoop alone can open aren't for this source."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    local = re.sub(r"^file:/+", "/", uri)
    return (LocalFileSystem(), local) if local.startswith("/") else FileSystem.from_uri(uri)


class RecordedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return "symbol string, interval string, at long, value string"

    def reader(self, schema) -> RecordedReader:
        return RecordedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedSource)
