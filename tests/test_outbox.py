"""The outbox: each content once, whatever fails or comes again."""

import os

import pytest
from pyspark.sql import functions as F

from colloquy.sources import outbox as O

SCHEMA = "title string, path string, sha256 string"


def notes(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def published(spark, path):
    return sorted(map(tuple, O.ledger(spark, path, SCHEMA).collect()))


def test_each_content_once(spark, tmp_path):
    path = str(tmp_path / "box")
    assert O.entries(path) == [] and published(spark, path) == []
    first = notes(spark, ("b", "/2", "x"), ("a", "/1", "x"), ("c", "/3", "y"), ("d", "/4", None))
    for _ in range(3):
        O.publish(first.repartition(4), path)
    assert published(spark, path) == [("a", "/1", "x"), ("c", "/3", "y")] and O.entries(path) == [0, 1, 2]
    O.publish(notes(spark, ("e", "/5", "z"), ("a", "/1", "y")), f"file://{path}")
    assert published(spark, f"file://{path}") == [("a", "/1", "x"), ("c", "/3", "y"), ("e", "/5", "z")]
    O.publish(first.limit(0), path)
    assert len(published(spark, path)) == 3


def test_a_failed_attempt_publishes_nothing_and_leaves_no_files(spark, tmp_path):
    path = str(tmp_path / "box")
    O.publish(notes(spark, ("a", "/1", "x")), path)
    before = sorted(os.listdir(path))
    bad = spark.range(100).repartition(4).select(F.lit("t").alias("title"), F.col("id").cast("string").alias("path"), F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("sha256"))
    with pytest.raises(Exception, match="lost"):
        O.publish(bad, path)
    assert published(spark, path) == [("a", "/1", "x")] and O.entries(path) == [0]
    assert sorted(os.listdir(path)) == before
    O.publish(bad.withColumn("sha256", F.col("path")), path)
    assert len(published(spark, path)) == 101


def test_of_two_writers_one_commits(spark, tmp_path):
    path = str(tmp_path / "box")
    O.publish(notes(spark, ("a", "/1", "x")), path)
    late = O.OutboxWriter(path, -1)  # has not seen the entry
    staged = late.write(iter(notes(spark, ("b", "/2", "x")).toArrow().to_batches()))
    with pytest.raises(RuntimeError):
        late.commit([staged, None])
    assert published(spark, path) == [("a", "/1", "x")] and not os.path.exists(staged.paths[0])
