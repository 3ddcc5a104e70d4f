"""What the operators share: word splitting, streaming over Arrow batches, checkpoints in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step of a Python worker handles at once; a single longer text is a step of its own.
STEP_BYTES = 4 << 20
BATCH_BYTES = 4 << 20
#: What Spark says where nobody has set the bound.
DEFAULT_BATCH_BYTES = f"{64 << 20}b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset on a single machine (tests), a local one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="colloquy-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: cuts the lineage, survives lost executors. It goes when
    the application ends, if not before (`dropped`)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("null"))) % modulus


def slices(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose texts have about `most` bytes, so that memory stays bounded for long texts."""
    if not batch.num_rows:
        return
    lengths = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(lengths + 64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def add_columns(df: DataFrame, needs: dict[str, Column], new: dict[str, str], make: Callable[[pa.RecordBatch], dict[str, pa.Array]], sized: str | None = None, step: int = STEP_BYTES, after: Callable[[], None] | None = None) -> DataFrame:
    """df with the columns that `make` gives for runs of rows; a column of df with such a name is replaced.

    needs: what make reads besides, gone afterwards. sized: the text in it that bounds a run's size. after: what a task
    does at its end. No shuffle.
    """
    bounded_batches(df.sparkSession)
    replaced = {c.lower() for c in new}
    kept = [c for c in df.columns if c.lower() not in replaced]
    fields = [df.schema[c] for c in kept]
    hidden = {c: f"_needs_{i}" for i, c in enumerate(needs)}  # clashes with no column of df
    while set(hidden.values()) & set(df.columns):
        hidden = {c: f"_{h}" for c, h in hidden.items()}
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[needs[c].alias(h) for c, h in hidden.items()])
    at = len(kept)
    names = list(needs)
    schema = T.StructType([*fields, *T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in new.items())).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                seen = pa.RecordBatch.from_arrays(batch.columns[at:], names=names)
                start = 0
                for part in slices(seen, sized, step) if sized else [seen]:
                    made = make(part)
                    own = batch.slice(start, part.num_rows).columns[:at]
                    start += part.num_rows
                    yield pa.RecordBatch.from_arrays([*own, *[made[k] for k in new]], names=[*kept, *new])
        finally:
            if after:
                after()
            release()

    return source.mapInArrow(run, schema)


def release() -> None:
    """Gives back what a task's Python worker has freed; it goes on with other stages and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim keeps it
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that releases memory at a task's end."""

    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return to_the_end


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES between the JVM and its Python workers, unless the session sets a bound itself."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == DEFAULT_BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def keep_where(docs: DataFrame, test: Callable[[list[str | None]], list[bool]], text: str = "text") -> DataFrame:
    """docs whose whole text passes a test; only the texts go to Python, the rows stay in the JVM."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def passes(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        return pa.array([ok for part in slices(batch, "text", 1 << 20) for ok in test(part.column("text").to_pylist())], pa.bool_())

    return docs.filter(passes(F.col(f"`{text}`").cast("string")))


class Ids(dict):
    """Word (bytes) to a 64-bit hash, remembered; forgets everything when it holds `most` words."""

    def __init__(self, most: int = 40_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word, 20240607)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the finaliser of a public mixing hash), elementwise."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Odd multipliers of the positions in a window.
_ODD = np.array([(2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1 for i in range(64)], dtype=np.uint64)


def windows(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash for each run of `width` consecutive words; empty with fewer words."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out += mix64(ids[i : i + n] + _ODD[i])  * _ODD[i]
    return mix64(out)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of rows with equal keys, of a stream sorted by the keys.

    A table ends where a group ends and holds about one batch; what is open at a batch's end waits for the next.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = changes(batch, keys)
        starts_new = bool(held) and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in keys)
        if starts_new:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            last = int(change[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def changes(rows: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Positions where a new group starts, 0 not among them. The keys hold no nulls."""
    n = rows.num_rows
    new = np.zeros(max(n - 1, 0), bool)
    for k in keys:
        c = rows.column(k)
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        values = c.to_numpy(zero_copy_only=False)
        new |= values[1:] != values[:-1]
    return np.flatnonzero(new) + 1
