"""Scalar functions on small inline values."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as X


def values(spark, f, *inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = {
    "vtt_seconds": (X.vtt_seconds, [("00:01:02.500", 62.5), ("01:02.250", 62.25), ("7", 7.0), ("x", 0.0), ("a:b", 0.0)]),
    "mmss": (X.mmss, [("0", "00:00"), ("-5", "00:00"), ("61.9", "01:01"), ("6000", "100:00"), ("x", "00:00")]),
    "hhmmss": (X.hhmmss, [("59", "00:59"), ("3600", "01:00:00"), ("3725", "01:02:05"), ("x", "unknown")]),
    "duration_seconds": (X.duration_seconds, [("12:34", 754), ("1:02:03", 3723), ("7", 0), ("x:1", 0), (None, 0), ("1:2:3:4", 0)]),
    "subtitle_language": (X.subtitle_language, [("a.ru.vtt", "ru"), ("a.en-US-orig.vtt", "en"), ("a.EN.vtt", "en"), ("a.vtt", None)]),
    "language_code": (X.language_code, [("Russian (auto)", "ru"), ("English", "en"), ("deutsch", "de")]),
    "language_hint": (X.language_hint, [(" RU ", "ru"), ("auto", None), ("", None)]),
    "slug": (X.slug, [("Héllo, Wörld!", "hello-world"), ("Привет", "notes"), ("", "notes"), (None, "notes")]),
    "title_text": (X.title_text, [("# <b>Deep</b> &amp; wide", "Deep & wide"), ("*00:01* **Speaker 1**: Hello  there", "Hello there"), ("— : start", "start"), (None, "")]),
    "person_text": (X.person_text, [("@maria", "maria"), ("- Anna | ", "Anna")]),
    "path_title": (X.path_title, [("dQw4w9WgXcQ-deep_learning-intro", "Deep learning intro"), ("deep-learning-intro", "Deep learning intro"), ("", "")]),
    "is_title": (X.is_title, [("abc", False), ("lecture", False), ("Speaker 2", False), ("12:30 - 4", False), ("Deep learning", True)]),
    "is_person": (X.is_person, [("A", False), ("Author", False), ("Speaker 3", False), ("Иван", True)]),
    "is_placeholder": (X.is_placeholder, [("—", True), ("", True), ("Unknown", True), ("speaker 1", True), ("Notion", False)]),
    "people": (X.people, [("Anna Smith met Иван Петров and anna smith, Anna Smith", ["Anna Smith", "Иван Петров"]), (None, [])]),
    "video_id": (X.video_id, [("https://youtu.be/ABCDEFGHIJ_?t=1", "ABCDEFGHIJ_"), ("https://youtube.com/watch?list=x&v=abcdefghijk", "abcdefghijk"), ("https://example.com", None)]),
    "statement": (X.statement, [("**Совет:** не бойся.", "не бойся"), ("— Проверь  это *(12:30)*", "Проверь это")]),
    "limit_text": (X.limit_text, [("a" * 141, "a" * 139 + "…"), ("a  b", "a b")]),
    "topic_tokens": (X.topic_tokens, [("Почему страх СТРАХ мешает the plan", ["страх", "страх", "мешает", "plan"])]),
    "split_values": (X.split_values, [("—; Notion, Miro|Figma", ["Notion", "Miro", "Figma"]), (None, [])]),
    "action_candidate": (X.action_candidate, [("Вопрос: «Что мешает?»", "Что мешает?"), ("Ритм: важен", "Ритм: важен")]),
    "imperative": (X.imperative, [("Проверь это", "Проверь это"), ("Страх мешает", "Проверь страх: страх мешает"), ("Первый шаг", "Зафиксируй первый шаг"), ("", "")]),
    "action_score": (X.action_score, [("сегодня запиши", 4), ("теория", -2), ("метод?", 2)]),
    "action_bucket": (X.action_bucket, [("сегодня запиши", "immediate"), ("не сопротивляйся", "ongoing"), ("вопрос и метод", "month"), ("просто текст", None)]),
    "summary_point": (X.summary_point, [("1. one  two ", "one two"), ("- x", "x"), ("plain", None)]),
    "checklist_action": (X.checklist_action, [("- [ ] Сделай  шаг", "Сделай шаг"), ("- [x] y", "y"), ("- z", None)]),
    "word_count": (X.word_count, [("don't стоп-слово 12", 3), ("", 0)]),
    "collapse_blank_lines": (X.collapse_blank_lines, [("a\n\n\n\nb\n", "a\n\nb")]),
    "split_lines": (X.split_lines, [("a\r\nb c\n", ["a", "b", "c"]), ("", []), ("\n", [""]), ("a\n\n", ["a", ""])]),
}


@pytest.mark.parametrize("name", CASES)
def test_scalar(spark, name):
    f, cases = CASES[name]
    assert values(spark, f, *[c[0] for c in cases]) == [c[1] for c in cases]


def test_chunk_label(spark):
    found = spark.createDataFrame([(0,), (25,), (26,), (701,), (702,), (18277,), (18278,)], "n long").select(X.chunk_label(F.col("n")).alias("x")).collect()
    assert [r["x"] for r in found] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA"]


def test_chunk_label_goes_on_after_four_letters(spark):
    found = spark.createDataFrame([(475253,), (475254,), (475279,), (12356629,), (12356630,)], "n long").select(X.chunk_label(F.col("n")).alias("x")).collect()
    assert [r["x"] for r in found] == ["ZZZZ", "AAAAA", "AAAAZ", "ZZZZZ", "AAAAAA"]


def test_note_id_order(spark):
    cols = "e string, k string, v string, c string, m string, p string, u string"
    rows = [("n", None, None, None, None, None, None), ("", "youtube", "vid", None, None, "/p", "u"), (None, "telegram", None, "1", "2", None, None), (None, "local", None, None, None, "/p", "u"), (None, "local", None, None, None, "", "u"), (None,) * 7]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {cols}")
    got = [r["x"] for r in df.select("i", X.note_id(*[F.col(c) for c in "ekvcmpu"], F.lit("b")).alias("x")).orderBy("i").collect()]
    assert got[:3] == ["n", "youtube:vid", "telegram:1:2"]
    assert [x.split(":")[0] for x in got[3:]] == ["file", "url", "bundle"]


def test_merge_json_and_maps(spark):
    df = spark.createDataFrame([('{"a": {"x": 1, "y": 2}, "b": [1]}', '{"a": {"y": null}, "b": [2, 3]}')], "a string, b string")
    assert df.select(X.merge_json("a", "b").alias("m")).first()["m"] == '{"a": {"x": 1, "y": null}, "b": [2, 3]}'
    got = spark.range(1).select(X.merge_maps(F.expr("map('k', '1', 'l', '2')"), F.expr("map('k', cast(null as string), 'm', '3')")).alias("m")).first()["m"]
    assert got == {"l": "2", "k": None, "m": "3"}


def test_hints_and_captions(spark):
    df = spark.createDataFrame([("", "Иван Петров", "Channel", None, "@handle")], "creator string, uploader string, channel string, artist string, handle string")
    r = df.select(X.author_hint(*[F.col(c) for c in df.columns]).alias("a"), X.speaker_candidates(*[F.col(c) for c in df.columns[:4]]).alias("c"), X.caption(F.lit("T"), F.lit("youtube"), F.lit("u"), F.lit("")).alias("cap"), X.caption(F.lit("T"), F.lit("x"), F.lit("u"), F.lit("")).alias("plain"), X.external_refs(F.lit("a, b\na"), F.lit(None).cast("string")).alias("refs"), X.delivery_name(F.lit('a/b: "c"\n'), ".html").alias("file")).first()
    assert r["a"] == "Иван Петров" and r["c"] == ["Иван Петров"]
    assert r["cap"] == "📝 Конспект видео: T\nu" and r["plain"] == "📝 Конспект: T"
    assert r["refs"] == ["a", "b"] and r["file"] == "a b c.html"
    lines = df.select(X.source_hint_lines(F.lit("A"), F.array(F.lit("B")), F.lit("ch"), F.lit(""), F.lit("@h")).alias("l"), X.source_hint_lines(F.lit(""), F.array().cast("array<string>"), F.lit(""), F.lit(None).cast("string"), F.lit("")).alias("n")).first()
    assert len(lines["l"]) == 5 and lines["l"][3].endswith("ch (@h)") and lines["n"] == []


def test_common_references_need_no_python(spark):
    import html

    rows = ["", "plain", "a &amp; b", "&amp;lt; &lt;&gt;&quot;&#39;", "&amp;amp;", "&eacute; &amp;", "& b", "&amp", "&am&amp;p;", None]
    got = spark.createDataFrame([(x,) for x in rows], "t string").select("t", X.unescape("t").alias("x")).collect()
    assert [r["x"] for r in got] == [x if x is None else html.unescape(x) for x in rows]
    assert {html.unescape(k): k for k in X.REFERENCES} == {v: k for k, v in X.REFERENCES.items()}
