"""Logs that grow at their ends, as tables and streams of lines: offsets are bytes, partitions ranges of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from oriel.sources.files import PIECE, located

SCHEMA = "log string, at long, line string"
#: Bytes of one log that one task reads.
TASK_BYTES = 64 << 20
#: Lines of one batch.
BATCH = 8192


@dataclass
class Lines(InputPartition):
    """Lines of ``path`` that begin in ``[start, stop)``; ``first`` and ``last`` are where lines begin and end."""

    path: str
    first: int
    start: int
    stop: int
    last: int


def whole_lines(system: fs.FileSystem, name: str, size: int, known: int = 0) -> int:
    """Bytes up to the end of the last whole line; ``known`` is such an end. Read backwards from the end."""
    end = size
    with system.open_input_file(name) as f:
        while end > known:
            begin = max(known, end - PIECE)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return known


def ends(folder: str, known: dict[str, int]) -> dict[str, int]:
    """For each log of a folder where its last whole line ends; ``known`` are such ends of before."""
    system, root = located(folder)
    out = {}
    for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if f.type != fs.FileType.File or f.base_name.startswith((".", "_")):
            continue
        before = known.get(f.base_name, 0)
        # Of a log that became shorter no end is known; ``grown`` tells it.
        out[f.base_name] = whole_lines(system, f.path, f.size, before if before <= f.size else 0)
    return out


def grown(start: dict[str, int], end: dict[str, int]) -> None:
    """An error if a log is gone or has less than it had at the checkpoint, from which a restart goes on."""
    for name, before in start.items():
        if end.get(name, -1) < before:
            raise ValueError(f"{name} had {before} bytes in whole lines and has {end.get(name, 'none')}: a log must only grow")


def lines_of(part: Lines) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of each line that begins in the partition, without its end."""
    system, name = located(part.path)
    inside = part.start > part.first  # a line that begins earlier may go on here
    at, rest = part.start - inside, b""
    with system.open_input_file(name) as f:
        f.seek(at)
        while piece := f.read(min(PIECE, part.last - at - len(rest))):
            *lines, rest = (rest + piece).split(b"\n")
            for line in lines:
                if not inside:
                    if at >= part.stop:
                        return
                    yield at, line
                inside = False
                at += len(line) + 1
            if at >= part.stop and not inside:
                return


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[Lines]:
        cuts = ((name, start.get(name, 0), end[name]) for name in sorted(end))
        return [Lines(f"{self.folder}/{name}", a, x, min(x + self.task_bytes, b), b) for name, a, b in cuts for x in range(a, b, self.task_bytes)]

    def partitions(self) -> list[Lines]:
        return self.ranges({}, ends(self.folder, {}))

    def read(self, partition: Lines | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a table without partitions is asked for one
            return
        name, held = partition.path.rsplit("/", 1)[1], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"log": [name] * len(held), "at": pa.array([x for x, _ in held], pa.int64()), "line": [y.decode("utf-8", "replace") for _, y in held]})

        for row in lines_of(partition):
            held.append(row)
            if len(held) == BATCH:
                yield batch()
                held = []
        if held:
            yield batch()


class LogStreamReader(LogReader, DataSourceStreamReader):
    """An offset holds a number for each log, so it grows with the number of logs, not with their lines."""

    known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now = ends(self.folder, self.known)
        grown(self.known, now)
        self.known = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        grown(start, end)
        return self.ranges(start, end)

    def commit(self, end: dict) -> None:
        """Logs stay: another query may read them."""


class GrowingLog(DataSource):
    """``growing_log``: each line of the logs in the folder ``path`` with its log and first byte. ``taskBytes`` cuts long logs.

    A line counts once its end is written; what stands behind the last one waits. An empty line is a row, an empty or
    missing folder has none; bytes that aren't UTF-8 are replaced. As a stream, only what has been added is read, and a restart goes on at
    the checkpoint's bytes; a log that became shorter or is gone is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)


def log_lines(spark: SparkSession, folder: str, stream: bool = False, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(log, at, line) of the logs in ``folder``, as a table or a stream; see ``GrowingLog``."""
    spark.dataSource.register(GrowingLog)
    source = spark.readStream if stream else spark.read
    return source.format("growing_log").option("taskBytes", task_bytes).load(folder)
