"""Views over tables with null, repeated and odd rows."""

import pytest

from colloquy.plans import queries as Q
from colloquy.plans import views as V


def landed(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_turns_without_a_role_stay(spark, tmp_path):
    d = landed(spark, tmp_path, "conversations", [(1, 0, "user", "a"), (1, 1, None, "b\nc"), (1, 2, "assistant", None), (2, 0, None, "x")], "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, V.conversation_lines(spark, d).collect()))
    assert got == [("1", 1, "**Speaker 3**: a"), ("1", 2, "**Speaker 1**: b c"), ("1", 3, "**Speaker 2**: "), ("2", 1, "**Speaker 1**: x")]


def test_repeated_rows_count_as_often_as_they_stand(spark, tmp_path):
    text = "Title line\n1. The first point of the text.\n"
    rows = [(7, text, "en", "s", 1), (7, text, "en", "s", 1), (8, "Title line\n", "en", "s", 1), (None, "Other\n", "en", "s", 1), (9, None, "en", "s", 1), (9, "alone", "en", None, 1)]
    d = landed(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert V.doc_lines(spark, d, "source").filter("doc_id = 7").count() == 4
    points = Q.QUERIES["summary_points"](spark, d).collect()
    assert sum("first point" in r["point"] for r in points) == 2
    density = {r["source"]: r["words"] for r in Q.QUERIES["note_density"](spark, d).collect()}
    one = next(r["words"] for r in Q.QUERIES["note_density"](spark, landed(spark, tmp_path / "one", "documents", rows[1:], "doc_id long, text string, lang string, source string, n_chars long")).collect() if r["source"] == "s")
    assert density["s"] - one == 9


@pytest.mark.parametrize("query", ["source_chunk_plan", "chunk_lines"])
def test_lines_meet_groups_and_files_without_a_shuffle(spark, sf_dir, query):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")  # as if the texts were large
    try:
        plan = Q.QUERIES[query](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
