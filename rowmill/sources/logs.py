"""Log files by byte ranges: their last lines, what came since an offset, and both as a stream whose offsets are bytes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

from rowmill.sources.stores import opened

#: Bytes that a task reads of a file; that are read at a time when looking backwards.
RANGE, STEP = 64 << 20, 64 << 10
BATCH = 10_000


@dataclass
class Range(InputPartition):
    """Lines of ``file`` that begin in [start, stop); ``first`` and ``last`` bound what is read, and first begins a line."""

    file: str
    first: int
    start: int
    stop: int
    last: int


@dataclass
class Tail(InputPartition):
    file: str
    size: int
    lines: int


def files_of(path: str) -> list[tuple[str, int]]:
    """(file, length) of the logs: ``path`` itself, or all files below it but those whose names begin with ``_`` or ``.``."""
    fs, at = opened(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(head + info.path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
    hidden = lambda x: any(p[:1] in "_." for p in x.removeprefix(at).strip("/").split("/"))
    return sorted((head + x.path, x.size) for x in found if x.type == pafs.FileType.File and not hidden(x.path))


def whole_lines(file: str, low: int, size: int) -> int:
    """Where the last whole line of the first ``size`` bytes ends, looking back no further than ``low``."""
    fs, at = opened(file)
    with fs.open_input_file(at) as f:
        end = size
        while end > low:
            begin = max(low, end - STEP)
            f.seek(begin)
            if (found := f.read(end - begin).rfind(b"\n")) >= 0:
                return begin + found + 1
            end = begin
    return low


def last_lines(file: str, size: int, lines: int) -> int:
    """Where the last ``lines`` lines begin; no more is read than they have, rounded up to ``STEP``."""
    fs, at = opened(file)
    with fs.open_input_file(at) as f:
        end, left = size, lines
        while end > 0:
            begin = max(0, end - STEP)
            f.seek(begin)
            piece = f.read(end - begin)
            stop = len(piece) - 1 if end == size and piece.endswith(b"\n") else len(piece)
            while (found := piece.rfind(b"\n", 0, stop)) >= 0:
                left -= 1
                if not left:
                    return begin + found + 1
                stop = found
            end = begin
    return 0


def lines_in(r: Range) -> Iterator[tuple[int, bytes]]:
    """(offset, line) without its end. A range that does not begin a line begins after the one that runs into it."""
    fs, at = opened(r.file)
    with fs.open_input_file(at) as f:
        skip, rest = r.start != r.first, b""
        place = read = r.start - skip
        f.seek(place)
        while place < r.stop:
            found = rest.find(b"\n")
            if found < 0:
                piece = f.read(min(1 << 20, r.last - read))
                read += len(piece)
                rest += piece
                if piece:
                    continue
                found = len(rest)
                if not rest:
                    return
            *lines, tail = rest.split(b"\n") if found < len(rest) else [rest, b""]
            for line in lines:
                if not skip and place < r.stop:
                    yield place, line.removesuffix(b"\r")
                skip = False
                place += len(line) + 1
                if place >= r.stop:
                    return
            rest = tail


def ranges(file: str, start: int, end: int) -> list[Range]:
    return [Range(file, start, at, min(at + RANGE, end), end) for at in range(start, end, RANGE)]


class _Reads:
    def read(self, part: Range | Tail) -> Iterator[pa.RecordBatch]:
        if isinstance(part, Tail):
            begin = last_lines(part.file, part.size, part.lines)
            part = Range(part.file, begin, begin, part.size, part.size)
        rows: list[tuple[int, bytes]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part.file] * len(rows)), pa.array([at for at, _ in rows], pa.int64()), pa.array([line.decode("utf-8", "replace") for _, line in rows], pa.string())],
                names=["file", "at", "line"],
            )

        for row in lines_in(part):
            rows.append(row)
            if len(rows) == BATCH:
                yield batch()
                rows = []
        if rows:
            yield batch()


class LogReader(_Reads, DataSourceReader):
    def __init__(self, path: str, lines: int, since: dict[str, int]):
        self.path, self.lines, self.since = path, lines, since

    def partitions(self) -> list[InputPartition]:
        if self.lines:
            return [Tail(f, n, self.lines) for f, n in files_of(self.path)] or [Range("", 0, 0, 0, 0)]
        starts = lambda f, n: s if (s := self.since.get(f, 0)) <= n else 0  # noqa: E731  a shorter file began again
        return [r for f, n in files_of(self.path) for r in ranges(f, starts(f, n), n)] or [Range("", 0, 0, 0, 0)]

    def read(self, part: Range | Tail) -> Iterator[pa.RecordBatch]:
        return super().read(part) if part.file else iter(())


class LogStream(_Reads, DataSourceStreamReader):
    """Offsets: of each file, how many bytes of whole lines have been seen. What follows the last line end waits."""

    def __init__(self, path: str):
        self.path, self.known = path, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for file, size in files_of(self.path):
            low = self.known.get(file, 0)
            if size != low:
                self.known[file] = whole_lines(file, low if low <= size else 0, size)
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known = end | self.known
        begin = lambda f, n: s if (s := start.get(f, 0)) <= n else 0
        return [r for f, n in sorted(end.items()) if n != start.get(f, 0) for r in ranges(f, begin(f, n), n)]

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rowmill_logs"

    def schema(self) -> str:
        return "file string, at long, line string"

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"], int(self.options.get("lines", 0)), json.loads(self.options.get("since", "{}")))

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options["path"])


def log_lines(spark: SparkSession, path: str, since: dict[str, int] | None = None) -> DataFrame:
    """file, at (byte offset), line: all lines of the logs under ``path``, or those from the offsets ``since`` on. Large files are read by many tasks."""
    spark.dataSource.register(LogSource)
    return spark.read.format("rowmill_logs").option("since", json.dumps(since or {})).load(path)


def log_tail(spark: SparkSession, path: str, lines: int = 10) -> DataFrame:
    """file, at (from 1), line: the last lines of each log, found from its end; a log's size does not matter."""
    spark.dataSource.register(LogSource)
    rows = spark.read.format("rowmill_logs").option("lines", lines).load(path)
    return rows.select("file", F.row_number().over(Window.partitionBy("file").orderBy("at")).alias("at"), "line")


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """file, at (byte offset), line as a stream: each batch has the whole lines that were added since the one before.

    With the same checkpoint a later run goes on where the last one stopped. A log that became shorter is read from its
    beginning; one that was replaced by a file of the same size or more goes on at the old offset.
    """
    spark.dataSource.register(LogSource)
    return spark.readStream.format("rowmill_logs").load(path)
