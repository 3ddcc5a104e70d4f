"""An outbox whose ledger has each content once: a sink with commit and abort.

Tasks stage their rows as files of names of their own; only what the driver's commit enters into the log is published. An
entry has a number, is written beside and moved into place, and names the entry it follows: of two writers that saw the same
ledger the second one's commit fails and its files go. Attempts that failed are in no entry. What is sent where is up to
those who read the outbox.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from colloquy.sources.stores import store_of


@dataclass
class Staged(WriterCommitMessage):
    """The files that a task has staged."""

    paths: list[str]


class OutboxSource(DataSource):
    """Options: path, and after (the number of the entry that the rows were chosen against; -1 for none)."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def writer(self, schema: T.StructType, overwrite: bool) -> OutboxWriter:
        return OutboxWriter(self.options["path"], int(self.options["after"]))


class OutboxWriter(DataSourceArrowWriter):
    def __init__(self, path: str, after: int) -> None:
        self.path, self.after = path.rstrip("/"), after

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        store, top = store_of(self.path)
        out, to = None, f"{top}/{uuid.uuid4().hex}.parquet"
        for batch in batches:
            if out is None:
                store.create_dir(top, recursive=True)
                out = pq.ParquetWriter(to, batch.schema, filesystem=store)
            out.write_batch(batch)
        if out is None:
            return Staged([])
        out.close()
        return Staged([to])

    def commit(self, messages: list[Staged | None]) -> None:
        store, top = store_of(self.path)
        staged = [p for m in messages if m for p in m.paths]
        number = self.after + 1
        try:
            if number in entries(self.path):
                raise RuntimeError(f"the outbox has an entry {number} already: another writer was faster")
            store.create_dir(f"{top}/_log", recursive=True)
            beside = f"{top}/_log/{uuid.uuid4().hex}.part"
            with store.open_output_stream(beside) as f:
                f.write(json.dumps({"after": self.after, "files": staged}).encode())
            store.move(beside, f"{top}/_log/{number}.json")
        except BaseException:
            self.abort(messages)
            raise

    def abort(self, messages: list[Staged | None]) -> None:
        store, _ = store_of(self.path)
        for path in (p for m in messages if m for p in m.paths):
            if store.get_file_info(path).type == pafs.FileType.File:
                store.delete_file(path)


def entries(path: str) -> list[int]:
    store, top = store_of(path.rstrip("/"))
    if store.get_file_info(f"{top}/_log").type != pafs.FileType.Directory:
        return []
    names = [f.base_name for f in store.get_file_info(pafs.FileSelector(f"{top}/_log"))]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def ledger(spark: SparkSession, path: str, schema: str, upto: int | None = None) -> DataFrame:
    """What is published, up to an entry."""
    store, top = store_of(path.rstrip("/"))
    files = []
    for number in entries(path):
        if upto is None or number <= upto:
            with store.open_input_stream(f"{top}/_log/{number}.json") as f:
                files += json.loads(f.read())["files"]
    scheme = path.split(":", 1)[0] + ":" if path.startswith("file:") else ""
    return spark.read.schema(schema).parquet(*[scheme + f for f in files]) if files else spark.createDataFrame([], schema)


def publish(notes: DataFrame, path: str, by: str = "sha256") -> None:
    """Publishes the notes whose content (by) isn't in the ledger, one of each: that with the smallest other columns.

    Notes without a content are left out.
    """
    spark = notes.sparkSession
    spark.dataSource.register(OutboxSource)
    last = max(entries(path), default=-1)
    rest = [c for c in notes.columns if c != by]
    one = notes.filter(F.col(by).isNotNull()).groupBy(by).agg(F.min(F.struct(*rest)).alias("_r")).select(by, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*notes.columns)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in notes.schema.fields)
    new = one.join(ledger(spark, path, ddl, last).select(by), by, "left_anti").select(*notes.columns)
    new.write.format("outbox").option("path", path).option("after", str(last)).mode("append").save()
