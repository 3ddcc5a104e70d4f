"""Files in the stores that executors reach by themselves: ranges of lines, hashes and copies, in blocks of bounded size.

Spark's own readers hold a file, or a line up to a line feed, in one cell. What is here streams instead: a task asks the
store's file system for the bytes of its range or file and keeps one block at a time.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from colloquy.sources.readers import list_files, replacing_decode

BLOCK = 1 << 20
RANGE_BYTES = 128 << 20
#: Small ranges and files go to a task together up to so many bytes.
TASK_BYTES = 4 << 20
#: Bytes of lines that are handed on at once.
BATCH_BYTES = 4 << 20
#: The line ends of a text, in UTF-8; none of them can be part of another character.
LINE_END = re.compile(rb"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]|\xc2\x85|\xe2\x80[\xa8\xa9]")
#: Bytes of the longest of them.
LONGEST_END = 3


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it: local files and whatever pyarrow knows (hdfs, s3, gs, ...)."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    return pafs.FileSystem.from_uri(path)


def owned_lines(file: pa.NativeFile, start: int, stop: int, block: int = BLOCK) -> Iterator[bytes]:
    """The lines that start in [start, stop), without their ends. A line starts at 0 or behind a line end.

    What a range needs beyond it is read on: the rest of its last line. One block and one line are held.
    """
    at = max(0, start - LONGEST_END)  # where `have` stands in the file; a line end that ends at start begins there or later
    file.seek(at)
    have, done = bytearray(), False

    def next_end(place: int) -> tuple[int, int] | None:
        """Where the next line end from place on starts and ends; reads on until nothing to come can make it longer."""
        nonlocal done
        while True:
            m = LINE_END.search(have, place)
            if m and (done or m.end() + LONGEST_END <= len(have)):
                return m.span()
            if done:
                return None
            place = max(place, m.start() if m else len(have) - LONGEST_END)
            got = file.read(block)
            have.extend(got)
            done = not got

    place = 0
    while start and at + place < start:  # to the first line that starts in the range
        found = next_end(place)
        if not found:
            return
        place = found[1]
    while at + place < stop:
        found = next_end(place)
        end, following = found or (len(have), len(have))
        if found or place < end:
            yield bytes(have[place:end])
        if not found:
            return
        place = following
        if place >= block:
            del have[:place]
            at, place = at + place, 0


class Range(InputPartition):
    """Pieces (path, start, stop) of files that one task reads."""

    def __init__(self, pieces: list[tuple[str, int, int]]) -> None:
        super().__init__(0)
        self.pieces = pieces


class LineRanges(DataSource):
    """Lines of files as (path, start, line_in_range, content); start is that of the range, content is bytes.

    Options: path (a file or a folder, read with all folders within), range_bytes. A range that is larger than a file
    holds it whole; a task reads one range, or several up to TASK_BYTES.
    """

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return "path string, start long, line_in_range long, content binary"

    def reader(self, schema) -> LineRangeReader:
        return LineRangeReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


class LineRangeReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        store, top = store_of(self.path)
        info = store.get_file_info(top)
        found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(top, recursive=True))
        files = [f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
        out, held, total = [], [], 0
        for f in sorted(files, key=lambda f: f.path):
            for start in range(0, f.size, self.size):
                stop = min(start + self.size, f.size)
                if held and total + stop - start > max(self.size, TASK_BYTES):
                    out.append(Range(held))
                    held, total = [], 0
                held.append((f.path, start, stop))
                total += stop - start
        return [*out, Range(held)] if held else out or [Range([])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        for path, start, stop in partition.pieces:
            with store.open_input_file(path) as file:
                held, size, first = [], 0, 0
                for line in owned_lines(file, start, stop):
                    held.append(line)
                    size += len(line) + 32
                    if size > BATCH_BYTES:
                        yield batch_of(path, start, first, held)
                        held, size, first = [], 0, first + len(held)
                if held:
                    yield batch_of(path, start, first, held)


def batch_of(path: str, start: int, first: int, lines: list[bytes]) -> pa.RecordBatch:
    n = len(lines)
    columns = [pa.array([path] * n), pa.array([start] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["path", "start", "line_in_range", "content"])


def read_line_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id (the path), line_no (from 1) and text of files of any size: the rows of readers.read_lines.

    A range is numbered by its task; where it starts in the file is the sum of the lines of the ranges before it, of which
    there is a row each. These numbers are joined to the lines, by a broadcast while they are small.
    """
    spark.dataSource.register(LineRanges)
    lines = spark.read.format("line_ranges").option("path", path).option("range_bytes", str(range_bytes)).load()
    sizes = lines.groupBy("path", "start").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("path", "start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    line_no = F.col("_before") + F.col("line_in_range") + 1
    return lines.join(sizes, ["path", "start"]).select(F.col("path").alias("doc_id"), line_no.alias("line_no"), replacing_decode(F.col("content")).alias("text"))


# Whole files


def blocks(path: str) -> Iterator[bytes]:
    store, at = store_of(path)
    with store.open_input_stream(at, compression=None) as source:
        while data := source.read(BLOCK):
            yield data


def hashed(path: str) -> tuple[int, str]:
    """The bytes and the SHA-256 of a file."""
    digest, size = hashlib.sha256(), 0
    for data in blocks(path):
        digest.update(data)
        size += len(data)
    return size, digest.hexdigest()


def copied(path: str, target: str) -> tuple[int, str]:
    """As hashed, while the file is copied: to a name of its own first, which becomes target when all is written."""
    store, at = store_of(target)
    own = f"{at}.part-{uuid.uuid4().hex}"
    digest, size = hashlib.sha256(), 0
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    try:
        with store.open_output_stream(own, compression=None) as out:
            for data in blocks(path):
                digest.update(data)
                out.write(data)
                size += len(data)
        store.move(own, at)
    except BaseException:
        if store.get_file_info(own).type == pafs.FileType.File:
            store.delete_file(own)
        raise
    return size, digest.hexdigest()


def dealt(files: DataFrame) -> DataFrame:
    """A row per file, dealt to tasks by path, as rows of a few bytes may stand for files of any size."""
    return files.repartition(max(1, 4 * files.sparkSession.sparkContext.defaultParallelism), "path")


def file_hashes(spark: SparkSession, folder: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """path, bytes and sha256 of a folder's files; a task holds a block of a file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            size, digest = hashed(path)
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([size], pa.int64()), "sha256": [digest]})

    return dealt(list_files(spark, folder, extensions).select("path")).mapInArrow(run, "path string, bytes long, sha256 string")


def copy_files(files: DataFrame) -> DataFrame:
    """path, target, bytes and sha256 of each file (path, target) that has been copied.

    A task that is run again copies again; what a reader sees under target is a whole file at any time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, target in zip(batch.column("path").to_pylist(), batch.column("target").to_pylist(), strict=True):
                size, digest = copied(path, target)
                yield pa.RecordBatch.from_pydict({"path": [path], "target": [target], "bytes": pa.array([size], pa.int64()), "sha256": [digest]})

    return dealt(files.select("path", "target")).mapInArrow(run, "path string, target string, bytes long, sha256 string")
