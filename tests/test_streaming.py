"""The trace log as a stream, against the same functions on batches."""

import json

from pyspark.sql import functions as F

from colloquy.plans import streams as ST
from colloquy.sources.readers import read_trace
from colloquy.streaming import trace as TR

EVENTS = [
    {"ts": "2024-01-01T10:00:00Z", "event": "run.started", "run_id": "r1", "note_id": "n"},
    {"ts": "2024-01-01T10:01:00Z", "event": "stage.prepare", "run_id": "r1", "note_id": "n", "duration_ms": 33},
    {"ts": "2024-01-01T10:02:00Z", "event": "stage.prepare", "run_id": "r1", "note_id": "n", "duration_ms": 11},
    {"ts": "2024-01-01T10:03:00Z", "event": "run.finished", "run_id": "r1", "note_id": "n", "props": '{"status": "assembled"}'},
    {"ts": "2024-01-01T10:04:00Z", "event": "run.started", "run_id": "r2", "note_id": "m"},
    {"ts": "2024-01-01T10:05:00Z", "event": "batch.file.failed", "note_id": "m"},
]


def folder(tmp_path):
    d = tmp_path / "trace"
    d.mkdir()
    for i, e in enumerate(EVENTS):
        (d / f"{i}.json").write_text(json.dumps(e) + "\n")
    return str(d)


def test_batch(spark, tmp_path):
    events = read_trace(spark, folder(tmp_path))
    assert tuple(TR.stage_metrics(events).first()) == ("prepare", 2, 44, 33)
    assert TR.latest_stage(events).first()["duration_ms"] == 11
    assert {r["run_id"]: r["status"] for r in TR.run_ledger(events).collect()} == {"r1": "assembled", "r2": "failed"}
    assert {r["state"]: r["files"] for r in TR.batch_progress(events).collect()} == {"failed": 1}
    active = spark.createDataFrame([("b", "r9", "n9")], "bundle_id string, active_run_id string, active_note_id string")
    assert TR.stamped(events.filter("run_id is null").withColumn("bundle_id", F.lit("b")), active).first()["run_id"] == "r9"


def test_stream(spark, tmp_path):
    path = folder(tmp_path)
    metrics = TR.stage_metrics(TR.stream_trace(spark, path), window="10 minutes")
    q = metrics.writeStream.format("memory").queryName("metrics").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(60)
    assert tuple(spark.table("metrics").select("stage", "events", "total_ms").first()) == ("prepare", 2, 44)
    ledger = TR.run_ledger(TR.stream_trace(spark, path))
    q = ledger.writeStream.format("memory").queryName("ledger").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(60)
    assert {r["run_id"]: r["status"] for r in spark.table("ledger").collect()}.get("r1") == "assembled"


def test_resume(spark, tmp_path):
    plan = spark.createDataFrame([("w", "A", "f1"), ("w", "B", "f2")], "work_id string, chunk_id string, chunk_fingerprint string")
    done = spark.createDataFrame([("w", "A", "f1")], "work_id string, chunk_id string, chunk_fingerprint string")
    seen = []
    TR.resume_each(plan, lambda: done, lambda df: seen.extend(r["chunk_id"] for r in df.collect()))(plan, 0)
    assert seen == ["B"]


def test_a_part_lands_in_many_files_and_is_one_batch(spark, tmp_path):
    table = spark.range(0, 1000, 1, 8)
    folder, parts = ST.landed(table, "numbers", F.col("id") % 5)
    seen, files = [], 0
    for _ in parts:
        now = len(spark.read.schema("id long").parquet(folder).inputFiles())
        assert now - files > 1  # no task holds a part
        files = now
        ST.streamed(spark, folder, table.schema, lambda b, k: seen.append((k, b.count())), str(tmp_path / "checkpoint"))
    ST.streamed(spark, folder, table.schema, lambda b, k: seen.append((k, b.count())), str(tmp_path / "checkpoint"))
    assert seen == [(k, 200) for k in range(5)]
