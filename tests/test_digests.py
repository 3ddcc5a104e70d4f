"""Digests of ordered rows and file meta in two levels, against plain versions."""

import hashlib
import random

from pyspark.sql import functions as F

from colloquy.operators import digests as D
from colloquy.operators import lines as LN


def test_digests_of_groups_over_many_batches(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "ж"]), rng.randrange(3), i, rng.choice([None, "", "text\n", "é" * 5]), i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, at int, text string, n int").withColumn("head", F.concat_ws("-", "g", F.col("k").cast("string")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["g"], r["k"]): (r["sha256"], r["n"], r["about"]) for r in D.ordered_digests(df.withColumn("about", F.struct("g", "k")), ["g", "k"], "at", "text", "head", ("n",), ("about",)).collect()}
        plain = {(r["g"], r["k"]): r["sha256"] for r in D.ordered_digests(df, ["g", "k"], "at", "text").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for g, k, _, t, n in rows:
        groups.setdefault((g, k), []).append((t, n))
    assert got.keys() == plain.keys() == groups.keys()
    for (g, k), own in groups.items():
        body = "\n".join(t for t, _ in own if t is not None)
        head = f"{g}-{k}" if g else str(k)
        assert got[g, k] == (hashlib.sha256(f"{head}\n{body}".encode()).hexdigest(), sum(n for _, n in own), (g, k))
        assert plain[g, k] == hashlib.sha256(body.encode()).hexdigest()
    assert D.ordered_digests(df.limit(0), ["g"], "at", "text").count() == 0


def test_names_of_a_file_are_counted_without_a_set(spark):
    rows = [("f", i, f"**Speaker {i % 50}** and **Speaker 999**: hi" if i % 3 else f"Имя{i % 40}: меня зовут Аня *0{i % 6}:10*") for i in range(600)] + [("g", 0, ""), (None, 1, "A: b")]
    lines = spark.createDataFrame(rows, "doc_id string, line_no int, text string")
    plan = LN.file_meta(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan
    got = {r["doc_id"]: r for r in LN.file_meta(lines).collect()}
    features = LN.line_features(lines).collect()
    for doc in ("f", "g", None):
        own = [r for r in features if r["doc_id"] == doc]
        assert got[doc]["lines"] == len(own) and got[doc]["markers"] == len({m for r in own for m in r["markers"]})
        assert got[doc]["dialogue_speakers"] == len({r["speaker_name"] for r in own} - {None})
        assert got[doc]["dialogue_cues"] == sum(r["is_dialogue"] for r in own) and got[doc]["intro_cues"] == sum(r["is_intro"] for r in own)
        assert got[doc]["bytes"] == sum(len(r["text"].encode()) + 1 for r in own)
    assert got["f"]["markers"] > 50
