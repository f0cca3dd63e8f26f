"""Blocks of lines between blank lines, read by ranges of bytes: a Python data source for treebanks of any size.

A file is cut into ranges of ``split_bytes``.  A block belongs to the range in which the blank line right before it begins;
the first block of a file belongs to its first range.  So a range's task starts at the first blank line after its offset and reads
past its end until its last block is over: each block is read once, whatever the split size.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "line_blocks"
SPLIT_BYTES = 64 << 20
_ROWS = 1000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    stop: int


def blocks(file: io.BufferedIOBase, start: int, stop: int) -> Iterator[bytes]:
    """The blocks that belong to the bytes from ``start`` to ``stop``."""
    at, owned, lines = start, start == 0, []
    if start:
        file.seek(start - 1)
        at = start - 1 + len(file.readline())
    while line := file.readline():
        if line.strip(b" \t\r\n"):
            if owned:
                lines.append(line)
            elif at >= stop:
                return
        else:
            if lines:
                yield b"".join(lines)
                lines = []
            owned = at < stop
            if not owned:
                return
        at += len(line)
    if lines:
        yield b"".join(lines)


class _Reader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[InputPartition]:
        files, path = _open(self.path)
        info = files.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path, recursive=True))
        found = sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        return [_Range(f.path, a, min(a + self.split_bytes, f.size)) for f in found for a in range(0, f.size, self.split_bytes)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        files, _ = _open(self.path)
        rows = []
        with io.BufferedReader(files.open_input_file(partition.path), 1 << 20) as file:
            for block in blocks(file, partition.start, partition.stop):
                rows.append(block.decode(errors="replace"))
                if len(rows) == _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])


class LineBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


def line_blocks(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``value``: each block of lines of a file or of all files of a folder."""
    spark.dataSource.register(LineBlocks)
    return spark.read.format(FORMAT).option("split_bytes", str(split_bytes)).load(path)
