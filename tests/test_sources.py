"""Sources and sinks on small files and inline payloads."""

import json

from pyspark.sql import functions as F

from colloquy.sources import readers as R
from colloquy.sources import writers as W


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def lines(spark, text, doc="d"):
    return R.lines_of(spark.createDataFrame([(doc, text)], "doc_id string, text string"))


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("один\nдва\n".encode())
    (tmp_path / "b.txt").write_bytes(b"bad \xff byte")
    (tmp_path / "c.md").write_bytes(b"\x00\x01\x02not-text")
    got = R.read_lines(spark, f"{tmp_path}/a.md")
    assert [r["text"] for r in got.orderBy("line_no").collect()] == ["один", "два"]
    assert R.read_texts(spark, f"{tmp_path}/b.txt").first()["text"] == "bad � byte"
    binary = spark.read.format("binaryFile").load(f"{tmp_path}/*").select(F.regexp_extract("path", "([^/]+)$", 1).alias("n"), R.looks_binary(F.col("content")).alias("b"))
    assert dict(rows(binary, "n")) == {"a.md": False, "b.txt": False, "c.md": True}
    assert R.list_files(spark, str(tmp_path), (".md",)).count() == 2
    payload = spark.createDataFrame([(b"\x01\x02\x03abc",), (b"\x01abcdefghij",), (b"",), (None,)], "c binary").select(R.looks_binary(F.col("c")).alias("b"))
    assert [r["b"] for r in payload.collect()] == [True, False, False, False]


VTT = "WEBVTT\nKind: captions\nLanguage: ru\n\n1\n00:00:01.000 --> 00:00:02.000\n<c>Привет</c>\n мир &amp; все\n\n00:00:02.000 --> 00:00:03.000\nПривет мир & все\n\nNOTE skipped\n\n00:05.500 --> 00:06.000\nКонец\n\n00:07.000 --> 00:08.000\n\n"


def test_vtt(spark):
    cues = R.parse_vtt(lines(spark, VTT))
    assert rows(cues, "cue_no") == [("d", 1, 1.0, "Привет мир & все"), ("d", 2, 5.5, "Конец")]
    assert W.cues_to_markdown(cues).first()["text"] == "*00:01* Привет мир & все\n*00:05* Конец\n"
    assert R.parse_vtt(lines(spark, "")).count() == 0


def payloads(spark, *items):
    return spark.createDataFrame([(str(i), x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(items)], "doc_id string, content string")


def test_recognised_lines(spark):
    p = payloads(
        spark,
        {"segments": [{"start": 0, "text": " a "}, {"start": 61.5, "text": ""}, {"start": 65.2, "text": "b"}]},
        {"text": "only text"},
        {"utterances": [{"start_time": 3, "speaker": 0, "transcript": "", "text": "hi"}], "results": {"segments": [{"timestamp": "5", "speaker": 1, "content": "yo"}]}},
        "not json",
        {"segments": []},
    )
    plain = {(r["doc_id"], r["line_no"]): (r["text"], r["error"]) for r in R.recognised_lines(p).collect()}
    assert plain["0", 1] == ("*00:00* a", None) and plain["0", 2] == ("*01:05* b", None)
    assert plain["1", 1] == ("*00:00* only text", None)
    assert plain["3", 1][1] and plain["4", 1][1]
    named = {(r["doc_id"], r["line_no"]): r["text"] for r in R.recognised_lines(p, speakers=True).collect()}
    assert named["2", 1] == "**Speaker 0** *00:03* hi" and named["2", 2] == "**Speaker 1** *00:05* yo"
    assert named["1", 1] == "only text"


def test_diarized(spark):
    p = payloads(spark, {"segments": [{"start": 1, "speaker": "B", "text": "x"}, {"start": 2, "speaker": "B", "text": "y"}, {"start": 3, "speaker": "A", "text": "z"}, {"start": 4, "text": "none"}]})
    turns = R.diarized_turns(p)
    got = rows(turns.select("speaker", "text", "ts", "utt_no"), "utt_no")
    assert got == [("Speaker 2", "x y", "00:01", 1), ("Speaker 1", "z none", "00:03", 2)]
    assert W.turns_to_markdown(turns).first()["text"] == "**Speaker 2**: x y\n*00:01*\n\n**Speaker 1**: z none\n*00:03*\n"


def test_shifted_pieces(spark):
    pieces = spark.createDataFrame([("p1", "d", 0, 0.0), ("p2", "d", 1, 1800.0)], "piece_id string, doc_id string, piece_no int, offset_s double")
    segments = spark.createDataFrame([("p2", 1, 2.0, None, "b"), ("p1", 1, 1.0, None, "a")], "piece_id string, seg_no int, start_s double, speaker string, text string")
    assert rows(R.shifted(pieces, segments).select("seg_no", "start_s", "text"), "seg_no") == [(1, 1.0, "a"), (2, 1802.0, "b")]


def test_chapters(spark):
    schema = "doc_id string, chapters array<struct<start_time:double,title:string>>, description string"
    m = spark.createDataFrame([("a", [(0.0, "Intro"), (None, "x"), (75.9, " Two ")], ""), ("b", None, "0:00 Start\n1:02:03 End"), ("c", [], "0:00 only one")], schema)
    assert rows(R.chapters_of(m), "doc_id", "chapter_no") == [("a", 1, "0:00", "Intro", 0), ("a", 2, "1:15", "Two", 75), ("b", 1, "0:00", "Start", 0), ("b", 2, "1:02:03", "End", 3723)]


def test_metadata_and_cascade(spark):
    landed = spark.createDataFrame([("https://youtu.be/ABCDEFGHIJ_", "broken"), ("u", '{"id": "i", "title": "t"}'), ("none", "x")], "url string, content string")
    assert {r["url"]: (r["id"], r["title"], r["warning"] is None) for r in R.video_metadata(landed).collect()} == {"https://youtu.be/ABCDEFGHIJ_": ("ABCDEFGHIJ_", "ABCDEFGHIJ_", False), "u": ("i", "t", True)}
    c = spark.createDataFrame([("d", "api", True), ("d", "subtitles", True), ("d", "existing", False), ("e", "api", False)], "doc_id string, kind string, ok boolean")
    assert rows(R.best_source(c), "doc_id") == [("d", "subtitles", True)]
    b = spark.createDataFrame([("v", "/a", False, 9), ("v", "/b", True, 1), ("v", "/c", True, 2)], "video_id string, path string, has_transcript boolean, modified int")
    assert R.prior_bundle(b).first()["path"] == "/c"


def test_work_folder(spark, tmp_path):
    w = tmp_path / "w"
    w.mkdir()
    (w / "manifest_chunk_A.tsv").write_text("block_file\ttitle\tstart_time\tend_time\nchunk_A_block_01.md\tСтрах\t00:00\t04:00\n", encoding="utf-8")
    (w / "manifest_chunk_B.tsv").write_text('block_file\ttimestamp_start\ttimestamp_end\ttopic\tnames\tresources\tquotes_count\tcases\nb2\t1\t2\t"Рит""м"\tAnna\tMiro\t0\t0\n', encoding="utf-8")
    m = R.read_manifest(spark, f"{w}/manifest_*.tsv")
    assert rows(m.select("chunk_id", "topic", "timestamp_start", "names"), "chunk_id") == [("A", "Страх", "00:00", None), ("B", 'Рит"м', "1", "Anna")]
    tsv = W.manifest_tsv(m.withColumn("work_id", F.lit("w")).drop("doc_id")).first()["tsv"].split("\n")
    assert len(tsv) == 4 and tsv[0].startswith("block_file\t")
    (w / "chunk_A_block_01.md").write_text("---\nblock_id: A1\ntimestamp_start: \"00:00\"\ntopic: Страх\n---\n## Блок | 00:00–04:00 | Страх\ntext\n\n---\n", encoding="utf-8")
    (w / "chunk_AA_block_01.md").write_text("no matter\n", encoding="utf-8")
    (w / "chunk_B_block_02.md").write_text("## B\n", encoding="utf-8")
    blocks = R.blocks_of(R.read_texts(spark, f"{w}/chunk_*"))
    got = {r["chunk_id"]: r for r in blocks.collect()}
    assert (got["A"]["ts_start"], got["A"]["topic"], got["AA"]["body"]) == ("00:00", "Страх", "no matter\n")
    works = blocks.select("work_id").distinct().withColumns({"title": F.lit("T"), "header": F.lit(None).cast("string"), "tldr": F.lit("1. a\n"), "appendix": F.lit("# Z\n")})
    note = W.assembled_notes(works, blocks).first()["note"]
    assert note == "# T\n\n---\n\n## Коротко о главном\n\n1. a\n\n---\n\n## Страх (00:00–04:00)\ntext\n\n---\n\n## B\n\n---\n\nno matter\n\n---\n\n# Z\n"
    (w / "speakers.txt").write_text("# c\nNOTE: n\nSpeaker 1 → Иван\nUnmarked lines (x) → Мария\nbad\n", encoding="utf-8")
    assert rows(R.speaker_map_of(R.read_lines(spark, f"{w}/speakers.txt")).select("pattern", "replacement"), "pattern") == [("Speaker 1", "Иван"), ("Unmarked lines (x)", "Мария")]


def test_adjacent_json_and_report(spark):
    media = spark.createDataFrame([("/m/a.mp3",), ("/m/b.mp3",)], "path string")
    jsons = spark.createDataFrame([("/m/a.json", '{"segments": []}'), ("/m/b.json", "{}")], "path string, content string")
    assert rows(R.adjacent_json(media, jsons).select("path", "json_path"), "path") == [("/m/a.mp3", "/m/a.json"), ("/m/b.mp3", None)]
    text = "WORK_DIR: /w\nFiles: 2\nTotal lines: 30\n=== TOTAL CHUNKS: 4 ===\n"
    r = R.prepare_reports(spark.createDataFrame([("d", text)], "doc_id string, text string")).first()
    assert (r["work_dir"], r["files"], r["total_lines"], r["duration_estimate"], r["total_chunks"]) == ("/w", 2, 30, "unknown", 4)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)], "a string, b int")
    W.append_jsonl(df, str(tmp_path / "log"))
    W.append_jsonl(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    W.write_json(df, str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "doc")).first()["b"] == 1
    results = spark.createDataFrame([("a", "ok", None, "A <b>", "x.html"), ("b", "error", "e", None, None), ("c", "ok", None, "C", None)], "file string, status string, error string, title string, html string")
    r = W.batch_index(results).first()
    assert (r["total"], r["ok"], r["failed"]) == (3, 2, 1) and '<a href="x.html">A &lt;b&gt;</a>' in r["html"] and "(no HTML)" in r["html"]
    linked = spark.range(1).select(W.linked_times(F.lit("## Topic (1:02–1:03:04)\ntext 1:02"), F.lit("https://x/?v=1")).alias("t")).first()["t"]
    assert linked == "## Topic ([1:02](https://x/?v=1&t=62)–[1:03:04](https://x/?v=1&t=3784))\ntext 1:02"


def test_best_subtitles(spark):
    cues = spark.createDataFrame([(d, i, float(i), t) for d, n, t in (("en", 30, "x" * 20), ("ru", 25, "y" * 20), ("de", 3, "z" * 10), ("s", 2, "q" * 10)) for i in range(n)], "doc_id string, cue_no int, start_s double, text string")
    files = spark.createDataFrame([("en", "w", "a.en.vtt", None), ("ru", "w", "a.ru-orig.vtt", None), ("de", "w", "a.de.vtt", None), ("s", "v", "b.vtt", 300)], "doc_id string, work_id string, name string, seconds int")
    assert rows(R.best_subtitles(cues, files), "work_id") == [("v", "s", "b.vtt", None, 20), ("w", "ru", "a.ru-orig.vtt", "ru", 500)]
    snippets = spark.createDataFrame([("d", [(1.0, "a"), (2.0, " ")])], "doc_id string, snippets array<struct<start:double,text:string>>")
    assert rows(R.caption_cues(snippets), "cue_no") == [("d", 1, 1.0, "a")]


def test_hashes_and_prescan_text(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    assert R.file_hashes(spark, f"{tmp_path}/f").first()["sha256"].startswith("ba7816bf")
    sample = spark.createDataFrame([("d", 1, 2, "b"), ("d", 1, 1, "a"), ("d", 4, 1, "c")], "doc_id string, section int, line_no int, text string")
    assert W.prescan_text(sample).first()["text"] == "=== FIRST LINES ===\na\nb\n\n=== SPEAKER HINTS ===\nc\n"
    hints = spark.createDataFrame([("d", ["h1", "h2"])], "doc_id string, hint_lines array<string>")
    assert W.prescan_text(sample, hints).first()["text"].startswith("h1\nh2\n\n=== FIRST")
