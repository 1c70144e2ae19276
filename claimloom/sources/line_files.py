"""Line files read by byte ranges: as they grow, and from their ends.

``appended_lines`` is a streaming source whose offset is a file's length. A line belongs
to the range that holds its line feed, so a half-written last line waits, a range may
begin anywhere, and a range that is read again gives the same lines: lines appended
between two micro-batches arrive once, also after a restart from the checkpoint. Long
ranges are dealt in stretches, a task each. ``last_bytes`` and ``last_lines`` are batch
sources that read the end of each file and nothing else.

Files are found and opened by Arrow's file systems, by the name that Spark or Arrow has
for their scheme. Folders are searched in depth; names beginning with a dot or an
underscore are left out, as Spark does.

Defined results: ``path, at, value``, with ``at`` the byte at which a line begins. Lines
come without their line feed; bytes that aren't UTF-8 become replacement characters. An
empty file or folder gives no rows. A file that has become shorter is a new one and read
from its start. An empty line is a line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

LINES = "path string, at long, value string"
#: Bytes that one task reads of what was appended to a file, and that are read at once when a line's start is sought.
STRETCH, STEP = 64 << 20, 64 << 10
_SCHEME = re.compile("^s3[an]:")


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(_SCHEME.sub("s3:", path))


def open_file(path: str):
    system, name = file_system(path)
    return system.open_input_file(name)


def sizes_of(path: str, suffix: str = "") -> dict[str, int]:
    """The files at a place, by name, and their lengths."""
    system, name = file_system(path)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else re.match(r"(\w+://[^/]*)?", path)[0]
    info = system.get_file_info(name)
    if info.type == pyarrow.fs.FileType.File:
        return {path: info.size}
    if info.type == pyarrow.fs.FileType.NotFound:
        return {}
    found = system.get_file_info(pyarrow.fs.FileSelector(name, recursive=True))
    hidden = lambda f: any(part[0] in "._" for part in f.path[len(name) :].split("/") if part)
    return {prefix + f.path: f.size for f in found if f.type == pyarrow.fs.FileType.File and f.path.endswith(suffix) and not hidden(f)}


def line_start(file, before: int) -> int:
    """Where the line begins that holds the byte at ``before``: behind the last line feed before it."""
    while before > 0:
        begin = max(0, before - STEP)
        file.seek(begin)
        found = file.read(before - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        before = begin
    return 0


def lines_between(file, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """``(at, line)`` of the lines whose line feed stands from ``begin`` to before ``end``."""
    at = line_start(file, begin)
    file.seek(at)
    rest, here = b"", at
    while here < end:
        block = file.read(min(1 << 20, end - here))
        if not block:
            return
        here += len(block)
        *lines, rest = (rest + block).split(b"\n")
        for line in lines:
            yield at, line
            at += len(line) + 1


def lines_at_end(file, size: int, most: int, lone: bool = False) -> list[tuple[int, bytes]]:
    """The lines of a file's last ``most`` bytes; of a larger file the first, which is cut, is dropped.

    With ``lone``, a cut line that is all there is stays.
    """
    at = max(0, size - most)
    file.seek(at)
    data = file.read(size - at)
    if at:
        found = data.find(b"\n")
        if found >= 0 or not lone:
            cut = found + 1 if found >= 0 else len(data)
            at, data = at + cut, data[cut:]
    out = []
    lines = data.split(b"\n")
    for line in lines[:-1] if not lines[-1] else lines:
        out.append((at, line))
        at += len(line) + 1
    return out


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def _rows(path: str, lines) -> Iterator[tuple]:
    for at, line in lines:
        yield path, at, line.decode("utf-8", "replace")


class AppendedReader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str, stretch: int):
        self.path, self.suffix, self.stretch = path, suffix, stretch

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return sizes_of(self.path, self.suffix)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, size in sorted(end.items()):
            begin = start.get(path, 0)
            begin = 0 if begin > size else begin
            out += [Range(path, at, min(size, at + self.stretch)) for at in range(begin, size, self.stretch)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        with open_file(partition.path) as file:
            yield from _rows(partition.path, lines_between(file, partition.begin, partition.end))


class EndReader(DataSourceReader):
    def __init__(self, path: str, suffix: str, most: int, lines: int | None):
        self.path, self.suffix, self.most, self.lines = path, suffix, most, lines

    def partitions(self) -> list[Range]:
        return [Range(path, 0, size) for path, size in sorted(sizes_of(self.path, self.suffix).items())]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        # Spark asks once for nothing where there are no partitions
        if partition is None:
            return
        with open_file(partition.path) as file:
            found = lines_at_end(file, partition.end, self.most, lone=self.lines is not None)
        if self.lines is not None:
            while found and not found[-1][1]:
                found.pop()
            found = found[max(0, len(found) - self.lines) :]
        yield from _rows(partition.path, found)


class LineFiles(DataSource):
    """Options: ``path``, ``suffix``; ``stretch`` of a stream; ``most`` bytes and ``lines`` of a batch."""

    @classmethod
    def name(cls) -> str:
        return "line_files"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> AppendedReader:
        return AppendedReader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("stretch", STRETCH)))

    def reader(self, schema) -> EndReader:
        lines = self.options.get("lines")
        return EndReader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("most", 2 << 20)), int(lines) if lines is not None else None)


def appended_lines(spark: SparkSession, path: str, suffix: str = "", stretch: int = STRETCH) -> DataFrame:
    """A stream of the whole lines of files that grow."""
    spark.dataSource.register(LineFiles)
    return spark.readStream.format("line_files").option("path", path).option("suffix", suffix).option("stretch", stretch).load()


def last_bytes(spark: SparkSession, path: str, most: int = 2 << 20, suffix: str = "") -> DataFrame:
    """The whole lines of each file's last ``most`` bytes."""
    spark.dataSource.register(LineFiles)
    return spark.read.format("line_files").option("path", path).option("suffix", suffix).option("most", most).load()


def last_lines(spark: SparkSession, path: str, lines: int, most: int = 32 << 10, suffix: str = "") -> DataFrame:
    """The last ``lines`` lines of each file, as far as its last ``most`` bytes hold them; empty lines at its very end don't count."""
    spark.dataSource.register(LineFiles)
    return spark.read.format("line_files").option("path", path).option("suffix", suffix).option("most", most).option("lines", lines).load()
