"""Queries that run streams: tables land as files in the shared folder and come back in micro-batches, with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.plans.views import scratch, table
from colloquy.sources.shared import kept
from colloquy.streaming import tables as TB

QUERIES: dict = {}
#: Parts that a table lands in, each a micro-batch.
PARTS = 5


def query(f):
    QUERIES[f.__name__] = f
    return f


def landed(df: DataFrame, name: str, part: Column) -> tuple[str, Iterator[int]]:
    """The folder of a table that lands in PARTS parts, by a number, and an iterator that lands a part at each step.

    A part is as many files as tasks wrote it, so no task holds a part; what has landed since a stream's last start is its next batch.
    """
    folder = scratch(df.sparkSession, name)
    own = df.withColumn("_part", part)

    def parts() -> Iterator[int]:
        for k in range(PARTS):  # one after another, as they would land
            own.filter(F.col("_part") == k).drop("_part").write.mode("append").parquet(folder)
            yield k

    return folder, parts()


def streamed(spark: SparkSession, folder: str, schema: T.StructType, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs all that has landed since the last start through `each`, as one batch; goes on from the checkpoint."""
    source = spark.readStream.schema(schema).parquet(folder)
    started = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a trace: even events start a run, the odd one after them ends it, but for every tenth."""
    kind = F.when(F.col("event_id") % 2 == 0, "run.started").when(F.col("event_id") % 20 == 1, "run.note").otherwise("run.finished")
    props = F.when(F.col("event_id") % 3 == 0, '{"status": "assembled"}').otherwise("{}")
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", kind.alias("event"), F.floor(F.col("event_id") / 2).cast("string").alias("run_id"), F.col("user_id").cast("string").alias("note_id"), props.alias("props"))


@query
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs from five micro-batches of events, merged into a state table; one batch comes again and changes nothing."""
    events = trace_events(spark, sf_dir)
    folder, parts = landed(events, "events", F.pmod(F.floor(F.col("event_id") / 3), F.lit(PARTS)))
    state = TB.StateTable(spark, scratch(spark, "runs"), "run_id", TB.combined_runs, TB.RUN_STATE)

    def merge(batch: DataFrame, batch_id: int) -> None:
        state.merge(TB.run_rows(batch, batch_id), batch_id)

    checkpoint = scratch(spark, "checkpoint")
    for _ in parts:
        streamed(spark, folder, events.schema, merge, checkpoint)
    merge(spark.read.schema(events.schema).parquet(folder), 2)
    return TB.run_snapshot(state.read())


class Stopped(RuntimeError):
    """A run that was stopped half-way."""


@query
def resumed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, some told again and some changed: a stream does them as they land, is stopped half-way, goes on, and a last start finds nothing to do."""
    d = table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.col("doc_id").cast("string").alias("chunk"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    again = d.filter("doc_id % 4 = 0").withColumn("text", F.when(F.col("doc_id") % 8 == 0, F.concat("text", F.lit("\nchanged"))).otherwise(F.col("text")))
    told = d.withColumn("version", F.lit(1).cast("long")).unionByName(again.withColumn("version", F.lit(2).cast("long")))
    told = kept(told.withColumn("fingerprint", F.substring(F.sha2("text", 256), 1, 12)), "told")
    folder, parts = landed(told, "chunks", F.pmod(F.col("doc_id") + 2 * F.col("version"), F.lit(PARTS)))
    outputs, checkpoint = scratch(spark, "outputs"), scratch(spark, "checkpoint")
    sentinels = TB.StateTable(spark, scratch(spark, "sentinels"), "chunk", TB.newest_sentinels, TB.SENTINELS)
    stopped = []

    def work(todo: DataFrame, to: str) -> None:
        made = todo.select("chunk", "version", "fingerprint", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.length("text").cast("long").alias("chars"))
        made.write.mode("overwrite").parquet(to)
        if to.endswith("batch=2") and not stopped:  # the outputs of the batch are there, its sentinels aren't
            stopped.append(to)
            raise Stopped(to)

    each = TB.resumed(sentinels, work, outputs)
    for _ in parts:
        try:
            streamed(spark, folder, told.schema, each, checkpoint)
        except StreamingQueryException:
            if not stopped:
                raise
            streamed(spark, folder, told.schema, each, checkpoint)
    streamed(spark, folder, told.schema, each, checkpoint)
    made = spark.read.parquet(outputs)
    last = sentinels.read().select("chunk", F.col("sentinel.fingerprint").alias("fingerprint"))
    times = made.groupBy("chunk").agg(F.count("*").alias("times"), F.max_by(F.struct("lines", "chars"), "version").alias("_r"))
    return last.join(times, "chunk").select(F.col("chunk").cast("long").alias("doc_id"), "fingerprint", "times", "_r.lines", "_r.chars")
