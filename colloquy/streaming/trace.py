"""The trace log as a stream: events, runs, stage metrics. The same functions take batch tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.state import latest_state, pending
from colloquy.sources.schemas import TRACE

LATE = "1 hour"


def stream_trace(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The events of a folder of JSON lines files, as they arrive."""
    return spark.readStream.schema(TRACE).option("maxFilesPerTrigger", files_per_batch).json(folder)


def stamped(events: DataFrame, active: DataFrame) -> DataFrame:
    """Events with the run and note that were active in their bundle (bundle_id, active_run_id, active_note_id), where they name none."""
    own = events.join(active, "bundle_id", "left")
    return own.withColumns({"run_id": F.coalesce("run_id", "active_run_id"), "note_id": F.coalesce("note_id", "active_note_id")}).drop("active_run_id", "active_note_id")


def stage_metrics(events: DataFrame, window: str | None = None, late: str = LATE) -> DataFrame:
    """Events, total and longest duration by stage, of `stage.<name>` events; by window of event time if one is given."""
    own = events.filter(F.col("event").startswith("stage.")).withColumn("stage", F.substring("event", 7, 1 << 20))
    keys = ["stage"]
    if window:
        own = own.withWatermark("ts", late).withColumn("window", F.window("ts", window))
        keys = ["window", "stage"]
    return own.groupBy(*keys).agg(F.count("*").alias("events"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("longest_ms"))


def latest_stage(events: DataFrame) -> DataFrame:
    """The last metric of each note and stage (batch)."""
    own = events.filter(F.col("event").startswith("stage.")).withColumn("key", F.concat_ws("|", "note_id", "event"))
    return latest_state(own, "key", ("ts", "duration_ms"))


def run_ledger(events: DataFrame, late: str = LATE, timeout: str = "6 hours") -> DataFrame:
    """A row per start of a run: joined with its first finish; a run without a finish within the timeout has status `failed`.

    Both sides carry watermarks and the join bounds their distance, so that state is dropped once the timeout has passed.
    Of several finishes of a run the first that arrives counts in a stream, the earliest after the start in a table.
    """
    own = events.withWatermark("ts", late) if events.isStreaming else events
    start = own.filter("event = 'run.started'").select("run_id", "note_id", F.col("ts").alias("started_at"))
    finish = own.filter("event = 'run.finished'").select(F.col("run_id").alias("_run"), F.col("ts").alias("finished_at"), F.get_json_object("props", "$.status").alias("_status"))
    if events.isStreaming:
        finish = finish.dropDuplicatesWithinWatermark(["_run"])
    near = (F.col("run_id") == F.col("_run")) & (F.col("finished_at") >= F.col("started_at")) & (F.col("finished_at") <= F.col("started_at") + F.expr(f"interval {timeout}"))
    both = start.join(finish, near, "left_outer")
    if not events.isStreaming:
        first = F.min(F.when(F.col("finished_at").isNotNull(), F.struct("finished_at", "_status")))
        both = both.groupBy("run_id", "note_id", "started_at").agg(first.alias("_f")).select("run_id", "note_id", "started_at", "_f.finished_at", "_f._status")
    return both.select("run_id", "note_id", "started_at", "finished_at", F.coalesce(F.when(F.col("finished_at").isNotNull(), F.coalesce("_status", F.lit("finished"))), F.lit("failed")).alias("status"))


def batch_progress(events: DataFrame) -> DataFrame:
    """Files of batches by what happened: started, completed, failed."""
    own = events.filter(F.col("event").startswith("batch.file."))
    return own.groupBy(F.substring("event", 12, 1 << 20).alias("state")).agg(F.count("*").alias("files"))


def resume_each(plan: DataFrame, done: Callable[[], DataFrame], work: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: of the chunks that a micro-batch names, those that aren't done in their planned state go to `work`."""

    def run(batch: DataFrame, _: int) -> None:
        named = plan.join(batch.select("work_id", "chunk_id").distinct(), ["work_id", "chunk_id"], "left_semi")
        work(pending(named, done()))

    return run
