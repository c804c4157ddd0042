"""A data source of text lines in any charset, from files in byte ranges and from the CSV member of ZIP archives (SRC2, SRC6).

Spark's own readers split at line feeds of one byte, so they cannot split UTF-16, and they do not open archives. Here a
partition is a range of bytes of a file, or an archive; a line belongs to the range it begins in. Each line comes with its
file, its range and its number within that, so the first line of a file is known.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20
READ_BYTES = 1 << 20
#: Lines and characters of a batch; a line more may be over.
LINES = 10_000
CHARS = 4_000_000
SCHEMA = "path string, split int, number bigint, value string"
#: Byte order marks and the charsets they stand for.
MARKS = [(b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Range(InputPartition):
    """Bytes ``start`` to ``stop`` of a file; a whole archive if ``stop`` is None."""

    def __init__(self, path: str, split: int, start: int, stop: int | None) -> None:
        super().__init__(path)
        self.path, self.split, self.start, self.stop = path, split, start, stop


class CharsetLines(DataSource):
    """Options: ``paths`` (a JSON list), ``encoding``, ``split_bytes``. Paths that end in .zip are archives."""

    @classmethod
    def name(cls) -> str:
        return "charset_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CharsetReader:
        return CharsetReader(self.options)


class CharsetReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = json.loads(options["paths"])
        self.encoding = options.get("encoding", "utf-8")
        self.size = max(2, int(options.get("split_bytes", SPLIT_BYTES)))
        self.size -= self.size % 4  # ranges begin at whole characters of a fixed width
        self.size = max(4, self.size)

    def partitions(self) -> list[Range]:
        found = []
        for path in self.paths:
            if path.lower().endswith(".zip"):
                found.append(Range(path, 0, 0, None))
                continue
            system, place = opened(path)
            length = system.get_file_info(place).size or 0
            found += [Range(path, k, at, min(length, at + self.size)) for k, at in enumerate(range(0, max(1, length), self.size))]
        return found

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, place = opened(partition.path)
        lines = self._members(system, place) if partition.stop is None else self._range(system, place, partition)
        held, first, chars = [], 0, 0
        for line in lines:
            held.append(line)
            chars += len(line)
            if len(held) == LINES or chars >= CHARS:
                yield _batch(partition, first, held)
                held, first, chars = [], first + len(held), 0
        if held:
            yield _batch(partition, first, held)

    def _members(self, system: fs.FileSystem, place: str) -> Iterator[str]:
        """Lines of the first CSV member; an archive without one has none."""
        with system.open_input_file(place) as raw, zipfile.ZipFile(raw) as archive:
            members = [m for m in archive.namelist() if m.lower().endswith(".csv")]
            if members:
                with archive.open(members[0]) as member:
                    yield from _cut(lambda: member.read(READ_BYTES), self.encoding, 0, None)

    def _range(self, system: fs.FileSystem, place: str, partition: Range) -> Iterator[str]:
        with system.open_input_file(place) as raw:
            charset, mark = self.encoding, 0
            head = raw.read(4)
            for sign, name in MARKS:
                if head.startswith(sign) and (self.encoding.lower().startswith("utf-16") == name.startswith("utf-16")):
                    charset, mark = name, len(sign)
                    break
            width = 2 if charset.lower().startswith("utf-16") else 1
            start = partition.start or mark
            # a range that does not begin its file leaves its first, broken line to the one before
            begin = start if partition.start == 0 else start - width
            raw.seek(begin)
            lines = _cut(lambda: raw.read(READ_BYTES), charset, begin, partition.stop)
            if partition.start:
                next(lines, None)
            yield from lines


def _cut(read, charset: str, at: int, stop: int | None) -> Iterator[str]:
    """Lines of the bytes that ``read`` gives one after the other from place ``at``, as far as they begin before ``stop``."""
    if charset.lower() == "utf-16":
        charset = "utf-16-le"
    width = 2 if charset.lower().startswith("utf-16") else 1
    feed = "\n".encode(charset)
    rest = b""
    while True:
        data = read()
        rest += data
        begin = 0
        while (end := _feed(rest, feed, begin, width)) >= 0:
            if stop is not None and at >= stop:
                return
            yield rest[begin:end].decode(charset, "replace").rstrip("\r")
            at += end + width - begin
            begin = end + width
        rest = rest[begin:]
        if not data:
            break
    if rest and (stop is None or at < stop):
        yield rest.decode(charset, "replace").rstrip("\r")


def _feed(data: bytes, feed: bytes, begin: int, width: int) -> int:
    """The next line feed from ``begin`` on that lies at a whole character."""
    at = data.find(feed, begin)
    while at >= 0 and (at - begin) % width:
        at = data.find(feed, at + 1)
    return at


def _batch(partition: Range, first: int, lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_pydict(
        {
            "path": pa.array([partition.path] * n, pa.string()),
            "split": pa.array([partition.split] * n, pa.int32()),
            "number": pa.array(range(first, first + n), pa.int64()),
            "value": pa.array(lines, pa.string()),
        }
    )


def charset_lines(spark: SparkSession, paths: list[str], encoding: str = "utf-8", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines of files and archives: path, split, number, value."""
    spark.dataSource.register(CharsetLines)
    reader = spark.read.format("charset_lines").option("paths", json.dumps(paths)).option("encoding", encoding)
    return reader.option("split_bytes", str(split_bytes)).load()
