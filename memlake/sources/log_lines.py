"""Lines of growing log files as a Spark data source, for batches and streams, read by ranges of bytes.

    spark.dataSource.register(LogLines)
    spark.read.format("log_lines").option("tail", 65536).load("/logs")
    spark.readStream.format("log_lines").load("/logs")

Rows are (path, start, line): the byte at which the line begins, and the line without its
line break; invalid UTF-8 is replaced. Spark's own file stream takes a file once, when it
appears; this one takes what was added to a file, and begins a file anew that was
truncated or replaced. Files are opened through pyarrow, locally or by URI.

Options:
    suffix      files of a folder that count, at any depth (default: all but hidden ones)
    tail        batches only: of each file, the lines that begin within its last bytes; found by a
                seek, the rest of the file is not read
    blockBytes  bytes a task reads at most of one file (default 64 MiB); a line belongs to the block it begins in
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, start long, line string"
BLOCK, STEP, HEAD = 64 << 20, 64 << 10, 64


@dataclass
class Range(InputPartition):
    """Lines of a file that begin at a byte from start on and before end."""

    path: str
    start: int
    end: int


class Folder:
    """The files below a path."""

    def __init__(self, options) -> None:
        self.root = re.sub("^file:/+", "/", options["path"])
        self.suffix = options.get("suffix", "")
        self.block = int(options.get("blockBytes", BLOCK))

    def opened(self, path: str) -> io.BufferedReader:
        return io.BufferedReader(fs.FileSystem.from_uri(self.root)[0].open_input_file(path), 1 << 20)

    def sizes(self) -> dict[str, int]:
        system, root = fs.FileSystem.from_uri(self.root)
        top = system.get_file_info(root)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [top] if top.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda path: any(x[0] in "._" for x in path[len(root) :].split("/") if x)
        return {x.path: x.size for x in found if x.is_file and (x is top or x.path.endswith(self.suffix) and not hidden(x.path))}

    def cut(self, path: str, start: int, end: int) -> list[Range]:
        return [Range(path, at, min(at + self.block, end)) for at in range(start, end, self.block)]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark's one task of a scan without files
            return
        held: list[tuple[int, str]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            starts, lines = zip(*held, strict=True)
            return pa.record_batch([pa.array([part.path] * len(held)), pa.array(starts, pa.int64()), pa.array(lines)], ["path", "start", "line"])

        with self.opened(part.path) as f:
            for at, line in lines_from(f, part.start, part.end):
                held.append((at, line.removesuffix(b"\n").decode("utf-8", "replace")))
                size += len(line)
                if size > 1 << 20 or len(held) >= 10_000:
                    yield rows()
                    held.clear()
                    size = 0
        if held:
            yield rows()


def lines_from(f: io.BufferedIOBase, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(begin, line) of the lines that begin at a byte from start on and before end; a line begun before is passed over."""
    at = max(start - 1, 0)
    f.seek(at)
    while start and at < end:
        piece = f.readline(STEP)
        at += len(piece)
        if not piece:
            return
        if piece.endswith(b"\n"):
            break
    while at < end and (line := f.readline()):
        yield at, line
        at += len(line)


def whole(f: io.BufferedIOBase, size: int) -> int:
    """The byte after the last line break before size, found from the end; 0 where there is none."""
    while size:
        at = max(size - STEP, 0)
        f.seek(at)
        if (found := f.read(size - at).rfind(b"\n")) >= 0:
            return at + found + 1
        size = at
    return 0


class LogReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder = Folder(options)
        self.tail = int(options["tail"]) if "tail" in options else None

    def partitions(self) -> Sequence[InputPartition]:
        first = lambda size: 0 if self.tail is None or size <= self.tail else size - self.tail + 1
        return [r for path, size in sorted(self.folder.sizes().items()) for r in self.folder.cut(path, first(size), size)]

    def read(self, partition):
        return self.folder.read(partition)


class LogStream(DataSourceStreamReader):
    """Offsets hold, for every file, the end of its last whole line and its first bytes.

    A file that is shorter than before, or begins otherwise, is read from its beginning. One that was
    replaced by a longer one with the same first 64 bytes cannot be told from one that grew. The ranges
    of a batch follow from its two offsets alone, so a batch that runs again reads the same bytes.
    """

    def __init__(self, options) -> None:
        self.folder = Folder(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path, size in sorted(self.folder.sizes().items()):
            with self.folder.opened(path) as f:
                if end := whole(f, size):
                    f.seek(0)
                    out[path] = [end, f.read(min(HEAD, end)).hex()]
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for path, (to, head) in end.items():
            begun, old = start.get(path, (0, ""))
            out += self.folder.cut(path, begun if to >= begun and head.startswith(old) else 0, to)
        return out

    def read(self, partition):
        return self.folder.read(partition)


class LogLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options)
