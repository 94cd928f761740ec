"""Following files that grow: a streaming source whose offset is a map from file to byte."""

from __future__ import annotations

import fnmatch
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.base import strip

#: Bytes of a range that one task reads, and of a block that it holds.
RANGE_BYTES, BLOCK = 64 << 20, 4 << 20
SCHEMA = "raw string, address string, raw_offset bigint, first_line bigint"


def open_store(path: str):
    """The file system and its own name of a path; any scheme that Arrow knows, or a plain local path."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _first_line(file, size: int) -> int:
    """Checksum of a file's first line: what tells a file from a new one of the same name."""
    crc, at = 0, 0
    file.seek(0)
    while at < size:
        block = file.read(min(BLOCK, size - at))
        cut = block.find(b"\n")
        crc = zlib.crc32(block if cut < 0 else block[:cut], crc)
        if cut >= 0:
            break
        at += len(block)
    return crc


def _end_of_lines(file, size: int) -> int:
    """The byte after the last line end; what follows it is a line that is still being written."""
    at = size
    while at > 0:
        start = max(0, at - BLOCK)
        file.seek(start)
        cut = file.read(at - start).rfind(b"\n")
        if cut >= 0:
            return start + cut + 1
        at = start
    return 0


@dataclass
class Range(InputPartition):
    """Lines of a file that begin at ``start`` or later and before ``stop``; complete lines end at ``limit``."""

    path: str
    first_line: int
    start: int
    stop: int
    limit: int


class _Files:
    """What a folder's files hold now, and the ranges between two such states."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.pattern = options.get("pattern", "*")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.seen: dict[str, tuple] = {}

    def now(self) -> dict[str, list[int]]:
        """Each file's end of complete lines and its first line's checksum; files that did not change are not read."""
        from pyarrow import fs

        store, root = open_store(self.path)
        seen, out = {}, {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            hidden = any(part[:1] in "._" for part in info.path[len(root):].strip("/").split("/"))
            if info.type != fs.FileType.File or hidden or not info.size or not fnmatch.fnmatch(info.base_name, self.pattern):
                continue
            state = (info.size, info.mtime_ns)
            known = self.seen.get(info.path)
            if known is None or known[0] != state:
                with store.open_input_file(info.path) as file:
                    size = file.size()
                    end = _end_of_lines(file, size)
                    known = (state, [end, _first_line(file, end)] if end else None)
            seen[info.path] = known
            if known[1]:
                out[info.path] = known[1]
        self.seen = seen
        return out

    def ranges(self, start: dict, end: dict) -> list[Range]:
        """What was added between two states. A file that got shorter or has another first line is read from its start."""
        out = []
        for path, (limit, first_line) in sorted(end.items()):
            begin, known = start.get(path, (0, first_line))
            begin = begin if begin <= limit and known == first_line else 0
            out += [Range(path, first_line, at, min(at + self.range_bytes, limit), limit) for at in range(begin, limit, self.range_bytes)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        with store.open_input_file(part.path) as file:
            at = part.start
            if at:  # the line that holds the byte before belongs to the range before
                file.seek(at - 1)
                at = part.start - 1
                while at < part.limit:
                    block = file.read(min(BLOCK, part.limit - at))
                    cut = block.find(b"\n")
                    if not block or cut >= 0:
                        at = at + cut + 1 if block else part.limit
                        break
                    at += len(block)
            file.seek(at)
            rest: list[bytes] = []
            begin = read = at
            while begin < part.stop and read < part.limit:
                block = file.read(min(BLOCK, part.limit - read))
                if not block:
                    break  # the file got shorter after its end was noted; its next state is read from the start
                read += len(block)
                if b"\n" not in block:
                    rest.append(block)
                    continue
                lines = b"".join([*rest, block]).split(b"\n")
                rest = [lines.pop()]
                texts, offsets = [], []
                for line in lines:
                    if begin >= part.stop:
                        break
                    texts.append(line.decode("utf-8", "replace"))
                    offsets.append(begin)
                    begin += len(line) + 1
                n = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([part.path] * n, pa.string()),
                                                  pa.array(offsets, pa.int64()), pa.array([part.first_line] * n, pa.int64())],
                                                 names=["raw", "address", "raw_offset", "first_line"])


class _Tail(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.files = _Files(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.files.now()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.files.ranges(start, end)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.files.read(partition)


class _Whole(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = _Files(options)

    def partitions(self) -> list[Range]:
        return self.files.ranges({}, self.files.now()) or [Range(self.files.path, 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.files.read(partition) if partition.limit else iter(())


class GrowingLines(DataSource):
    """Lines of all files below a folder, with the byte each begins at; options path, pattern, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Whole(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Tail(self.options)


def _lines(df: DataFrame) -> DataFrame:
    lines = df.select(F.rtrim(F.col("raw"), F.lit("\r")).alias("raw"), F.lit("file").alias("source_type"), "address",
                      F.lit("file").alias("transport"), F.col("raw_offset"), F.col("first_line"))
    return lines.filter(strip(F.col("raw")) != "")


def _options(path: str, pattern: str, range_bytes: int) -> dict[str, str]:
    return {"path": path, "pattern": pattern, "range_bytes": str(range_bytes)}


def tail(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Follows the files below a folder (src_tail): each complete line once, with its byte offset, as a stream.

    The checkpoint holds for each file the byte up to which it was read. Only what was added is read, in ranges of
    ``range_bytes``; a last line without its end waits for it. A file that became shorter, or whose first line changed,
    counts as a new one and is read from its start. ``first_line`` is the first line's checksum; with the path and the
    offset it names a line, so that a restart, a second reader or another number of tasks gives the same ids.

    A file that is cut off and grows beyond its former size between two looks, with the same first line, is taken for
    the old one. The offset has an entry for each file; files that are gone leave it.
    """
    spark.dataSource.register(GrowingLines)
    return _lines(spark.readStream.format("growing_lines").options(**_options(path, pattern, range_bytes)).load())


def read(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """What ``tail`` would give for the files as they are now, as a table: offsets without any shuffle."""
    spark.dataSource.register(GrowingLines)
    return _lines(spark.read.format("growing_lines").options(**_options(path, pattern, range_bytes)).load())
