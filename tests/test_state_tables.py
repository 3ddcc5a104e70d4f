"""State tables merged by micro-batches, and chunks that are done once."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.streaming import tables as TB

SCHEMA = "k string, n long, first long"


def combine(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def table_of(spark, tmp_path):
    return TB.StateTable(spark, f"file://{tmp_path}/state", "k", combine, SCHEMA, buckets=4)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_merges_equal_one_batch_and_replays_change_nothing(spark, tmp_path):
    rng = random.Random(2)
    batches = [[(rng.choice("abcdefgh"), 1, rng.randrange(100)) for _ in range(20)] for _ in range(4)] + [[]]
    t = table_of(spark, tmp_path)
    assert t.entries() == [] and t.read().count() == 0
    for i, b in enumerate(batches):
        assert t.merge(spark.createDataFrame(b, SCHEMA), i)
        assert not t.merge(spark.createDataFrame(b, SCHEMA), i)
    assert rows(t.read()) == rows(combine(spark.createDataFrame([r for b in batches for r in b], SCHEMA)))
    assert table_of(spark, tmp_path).entries() == [0, 1, 2, 3, 4]


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = table_of(spark, tmp_path)
    t.merge(spark.createDataFrame([(x, 1, 1) for x in "abcdefghij"], SCHEMA), 0)
    before = t.files()
    t.merge(spark.createDataFrame([("a", 1, 0)], SCHEMA), 1)
    after = t.files()
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1
    assert ("a", 2, 0) in rows(t.read()) and t.read().count() == 10


def test_a_batch_that_failed_leaves_no_trace(spark, tmp_path):
    t = table_of(spark, tmp_path)
    t.merge(spark.createDataFrame([("a", 1, 1)], SCHEMA), 0)

    class Broken:
        def __getattr__(self, name):
            return getattr(store, name)

        def move(self, *_):
            raise OSError("lost")

    store, t.store = t.store, Broken()
    with pytest.raises(OSError):
        t.merge(spark.createDataFrame([("a", 5, 0)], SCHEMA), 1)
    t.store = store
    assert rows(t.read()) == [("a", 1, 1)] and t.entries() == [0]
    assert t.merge(spark.createDataFrame([("a", 5, 0)], SCHEMA), 1)
    assert rows(t.read()) == [("a", 6, 0)]


def test_runs_with_null_and_missing_parts(spark, tmp_path):
    events = [("2024-01-01 10:00:00", "run.started", "r1", "n", None), ("2024-01-01 10:05:00", "run.finished", "r1", "n", '{"status": "ok"}'), ("2024-01-01 10:07:00", "run.finished", "r1", "n", None), ("2024-01-01 10:01:00", "stage.x", "r2", None, None), ("2024-01-01 10:02:00", "run.started", "r3", None, "x"), ("2024-01-01 10:02:00", "run.started", None, None, "x")]
    e = spark.createDataFrame(events, "ts string, event string, run_id string, note_id string, props string").withColumn("ts", F.to_timestamp("ts"))
    t = TB.StateTable(spark, str(tmp_path / "runs"), "run_id", TB.combined_runs, TB.RUN_STATE)
    for i in range(3):
        t.merge(TB.run_rows(e.filter(F.minute("ts") % 3 == i), i), i)
    got = {r["run_id"]: (r["note_id"], r["status"], r["last_event"], r["events"]) for r in TB.run_snapshot(t.read()).collect()}
    assert got == {"r1": ("n", "ok", "run.finished", 3), "r2": (None, "unknown", "stage.x", 1), "r3": (None, "running", "run.started", 1)}


def test_chunks_are_done_once_a_fingerprint(spark, tmp_path):
    t = TB.StateTable(spark, str(tmp_path / "s"), "chunk", TB.newest_sentinels, TB.SENTINELS)
    seen = []

    def work(todo, to):
        seen.extend(sorted((r["chunk"], r["version"]) for r in todo.collect()))
        todo.select("chunk", "version", "fingerprint").write.mode("overwrite").parquet(to)
        if to.endswith("=1") and len(seen) == 3:
            raise RuntimeError("half-way")

    run = TB.resumed(t, work, str(tmp_path / "out"))
    batch = lambda *rows: spark.createDataFrame(rows, "chunk string, version long, fingerprint string")
    run(batch(("A", 1, "f"), ("A", 2, "g"), ("B", 1, "f")), 0)
    second = batch(("B", 2, "f"), ("A", 1, "f"), ("C", 1, "h"))
    with pytest.raises(RuntimeError):
        run(second, 1)
    run(second, 1)
    run(second, 1)
    run(batch(("C", 3, "i")), 2)
    assert seen == [("A", 2), ("B", 1), ("C", 1), ("C", 1), ("C", 3)]
    assert {r["chunk"]: tuple(r["sentinel"]) for r in t.read().collect()} == {"A": (2, "g", 0), "B": (1, "f", 0), "C": (3, "i", 2)}
