"""State tables that micro-batches are merged into, each batch once however often it is run.

A table is a folder of immutable Parquet files by bucket of the key, and a log with an entry for each merged batch, which
names the files that make up the table from then on. A merge rewrites only the buckets that its batch touches. An entry
appears as a whole (it is written beside and moved), so a batch that failed before it left no trace, and a batch whose
entry is there is not merged again. One writer at a time, as a streaming query is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.stores import store_of

BUCKETS = 16


class StateTable:
    """Rows of one key each. combine: from rows of the table and of batches, in the table's columns, to a row per key.

    combine must not depend on the order or the grouping of its rows (minima, maxima, sums of what stands in one batch only).
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, combine: Callable[[DataFrame], DataFrame], schema: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.key, self.combine, self.schema, self.buckets = spark, folder.rstrip("/"), key, combine, schema, buckets
        self.store, self.log = store_of(f"{self.folder}/_log")

    def entries(self) -> list[int]:
        """The merged batches, in order."""
        if self.store.get_file_info(self.log).type != pafs.FileType.Directory:
            return []
        names = [f.base_name for f in self.store.get_file_info(pafs.FileSelector(self.log))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def files(self) -> dict[str, str]:
        """The folder of each bucket, by the last entry."""
        merged = self.entries()
        if not merged:
            return {}
        with self.store.open_input_stream(f"{self.log}/{merged[-1]}.json") as f:
            return json.loads(f.read())

    def read(self, buckets: list[str] | None = None) -> DataFrame:
        found = [path for bucket, path in self.files().items() if buckets is None or bucket in buckets]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, batch_id: int) -> bool:
        """Merges a batch (in the table's columns); whether that was still to do. To be given to foreachBatch."""
        if batch_id in self.entries():
            return False
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("string")
        own = batch.select(*self.spark.createDataFrame([], self.schema).columns)
        touched = [r[0] for r in own.select(bucket).distinct().collect()]  # at most as many as there are buckets
        now = self.files()
        if touched:
            to = f"{self.folder}/batch-{batch_id}-{uuid.uuid4().hex}"
            rows = self.combine(self.read(touched).unionByName(own)).withColumn("_bucket", bucket)
            rows.repartition("_bucket").write.partitionBy("_bucket").parquet(to)
            now |= {b: f"{to}/_bucket={b}" for b in touched}
        self.store.create_dir(self.log, recursive=True)
        beside = f"{self.log}/{uuid.uuid4().hex}.part"
        with self.store.open_output_stream(beside) as f:
            f.write(json.dumps(now).encode())
        self.store.move(beside, f"{self.log}/{batch_id}.json")
        return True


RUN_STATE = "run_id string, started struct<ts:timestamp,note_id:string>, finished struct<ts:timestamp,status:string>, last struct<ts:timestamp,event:string>, events long, batch long"


def run_rows(events: DataFrame, batch_id: int = 0) -> DataFrame:
    """Events (ts, event, run_id, note_id, props) as rows of a run table: one per run of the batch."""
    status = F.coalesce(F.get_json_object("props", "$.status"), F.lit("finished"))
    return events.filter("run_id is not null").groupBy("run_id").agg(
        F.min(F.when(F.col("event") == "run.started", F.struct("ts", "note_id"))).alias("started"),
        F.min(F.when(F.col("event") == "run.finished", F.struct("ts", status.alias("status")))).alias("finished"),
        F.max(F.struct("ts", "event")).alias("last"),
        F.count("*").alias("events"),
        F.lit(batch_id).cast("long").alias("batch"),
    )


def combined_runs(rows: DataFrame) -> DataFrame:
    """Rows of a run table, one per run: the first start and finish, the last event, and all events."""
    return rows.groupBy("run_id").agg(F.min("started").alias("started"), F.min("finished").alias("finished"), F.max("last").alias("last"), F.sum("events").alias("events"), F.max("batch").alias("batch"))


def run_snapshot(state: DataFrame) -> DataFrame:
    """A row per run: when it started and finished, for which note, how it stands, and what was last heard of it."""
    status = F.when(F.col("finished").isNotNull(), F.col("finished.status")).when(F.col("started").isNotNull(), "running").otherwise("unknown")
    return state.select("run_id", F.col("started.note_id").alias("note_id"), F.col("started.ts").alias("started_at"), F.col("finished.ts").alias("finished_at"), status.alias("status"), F.col("last.event").alias("last_event"), F.col("last.ts").alias("last_at"), "events")


SENTINELS = "chunk string, sentinel struct<version:long,fingerprint:string,batch:long>"


def newest_sentinels(rows: DataFrame) -> DataFrame:
    """Rows of a sentinel table, one per chunk: that of the last version done."""
    return rows.groupBy("chunk").agg(F.max("sentinel").alias("sentinel"))


def resumed(table: StateTable, work: Callable[[DataFrame, str], None], outputs: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: does the chunks of a batch (chunk, version, fingerprint, ...) whose sentinel is missing or stale.

    Of several versions of a chunk in a batch the last counts, and none that is older than what is done. work writes what it
    makes of these rows to the folder that it is given, in place of what a failed attempt at the batch has left there; the
    sentinels follow when that is done. A batch that has its sentinels is not done again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id in table.entries():
            return
        rest = [c for c in batch.columns if c != "chunk"]
        last = batch.groupBy("chunk").agg(F.max_by(F.struct(*rest), "version").alias("_r")).select("chunk", "_r.*")
        done = table.read().select("chunk", F.col("sentinel.version").alias("_version"), F.col("sentinel.fingerprint").alias("_fingerprint"))
        todo = last.join(done, "chunk", "left").filter("_version is null or (version > _version and fingerprint <> _fingerprint)").drop("_version", "_fingerprint")
        folder = f"{outputs}/batch={batch_id}"
        work(todo, folder)
        made = batch.sparkSession.read.parquet(folder)
        table.merge(made.select("chunk", F.struct("version", "fingerprint", F.lit(batch_id).cast("long").alias("batch")).alias("sentinel")), batch_id)

    return run
