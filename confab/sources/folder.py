"""Transcript folders as a Spark data source, for batch and stream: ``spark.read.format("transcripts")``.

Files are listed once, filters on ``kind``, ``path`` and ``length`` are applied to the list, and
what is left is dealt into partitions of about equal bytes.  Files that a filter rejects, and kinds
that are no transcripts, are never opened (the latter are reported as rows).  A file is read whole
by one task; texts of any length by lines are :func:`confab.operators.segments.lines_of_files`.

Options: ``path`` (URI or local folder), ``recursive`` (true), ``partitionBytes`` (64 MiB), and for
streams ``settleSeconds`` (1): a file counts once it is that old, by its modification time.
"""

from __future__ import annotations

import datetime as dt
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

FORMAT = "transcripts"
SCHEMA = "path string, kind string, length long, modificationTime timestamp, raw string, error string"
#: What opening a file costs, in bytes.
OPEN_COST = 1 << 20


class File(NamedTuple):
    path: str
    kind: str
    length: int
    modified_us: int


@dataclass
class Files(InputPartition):
    files: list[File]


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def kind_of(path: str) -> str:
    name = path.rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name[1:] else ""


def listed(uri: str, recursive: bool) -> list[File]:
    """The files of a folder (or the one file), hidden ones left out, by path."""
    from pyarrow import fs

    system, root = _system(uri)
    base = system.get_file_info(root)
    infos = [base] if base.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=recursive))
    shown = [i for i in infos if i.type == fs.FileType.File and not any(part.startswith((".", "_")) for part in i.path[len(root) :].split("/"))]
    return sorted(File(i.path, kind_of(i.path), i.size, i.mtime_ns // 1000) for i in shown)


def dealt(files: list[File], partition_bytes: int) -> list[Files]:
    """Partitions of about equal bytes: the largest file first, always to the emptiest."""
    cost = lambda f: f.length + OPEN_COST
    n = max(1, -(-sum(map(cost, files)) // partition_bytes))
    heap: list[tuple[int, int, list[File]]] = [(0, k, []) for k in range(min(n, max(1, len(files))))]
    for f in sorted(files, key=lambda f: (-f.length, f.path)):
        used, k, own = heap[0]
        own.append(f)
        heapq.heapreplace(heap, (used + cost(f), k, own))
    return [Files(own) for _, _, own in sorted(heap, key=lambda x: x[1])]


_TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}


def as_test(f: Filter):
    """A predicate on files that stands for the whole filter; None if it needs more than the list."""
    inner = f.child if isinstance(f, Not) else f
    column = getattr(inner, "attribute", (None,))
    if type(inner) not in _TESTS or len(column) != 1 or column[0] not in ("path", "kind", "length"):
        return None
    test, name, value, want = _TESTS[type(inner)], column[0], inner.value, not isinstance(f, Not)
    if value is None:
        return None
    return lambda x: test(getattr(x, name), value) == want


def read_bytes(path: str, system) -> bytes:
    with system.open_input_stream(path) as f:
        return f.read()


def rows_of(files: list[File], uri: str) -> Iterator[tuple]:
    from confab.sources.files import TRANSCRIPT_SUFFIXES, extract

    system, _ = _system(uri)
    for f in files:
        known = f.kind in TRANSCRIPT_SUFFIXES
        try:
            raw, error = extract(f.kind, read_bytes(f.path, system) if known and f.length else b"")
        except OSError as e:
            raw, error = None, f"The file could not be read: {e}"
        yield f.path, f.kind, f.length, dt.datetime.fromtimestamp(f.modified_us / 1e6, dt.timezone.utc), raw, error


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.recursive, self.bytes = options["path"], str(options.get("recursive", "true")).lower() == "true", int(options.get("partitionBytes", 64 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if as_test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[Files]:
        tests = [as_test(f) for f in self.filters]
        return dealt([f for f in listed(self.uri, self.recursive) if all(t(f) for t in tests)], self.bytes)

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(partition.files, self.uri)


class FolderStream(DataSourceStreamReader):
    """Files by modification time; the offset is the time up to which all have been read."""

    def __init__(self, options: dict):
        self.batch, self.settle = FolderReader(options), float(options.get("settleSeconds", 1))

    def initialOffset(self) -> dict:
        return {"modified_us": -1}

    def latestOffset(self) -> dict:
        import time

        return {"modified_us": int((time.time() - self.settle) * 1e6)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        new = [f for f in listed(self.batch.uri, self.batch.recursive) if start["modified_us"] < f.modified_us <= end["modified_us"]]
        return dealt(new, self.batch.bytes)

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.batch.read(partition)


class TranscriptFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters pushed into it."""
    spark.dataSource.register(TranscriptFolder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def transcripts(rows: DataFrame) -> DataFrame:
    """Rows of the format with their texts normalised and parsed: (``path``, ``modificationTime``, ``text``, ``segments``, ``transcript``, ``error``)."""
    from confab.sources.files import parsed_texts

    return parsed_texts(rows, ["path", "modificationTime"])
