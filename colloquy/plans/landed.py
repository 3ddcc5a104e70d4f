"""Queries over texts that land as files do: captions, payloads, manifests, blocks, reports and notes.

Each table is written from the driver's tables as a tool would leave it (one text a row, its path or id beside it) and
then goes through the reader, operator or sink as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import contract as CT
from colloquy.operators import lines as LN
from colloquy.operators import plan as PL
from colloquy.operators import prompts as PR
from colloquy.plans.views import conversation_lines, table
from colloquy.sources import readers as RD
from colloquy.sources import writers as WR
from colloquy.streaming import trace as TR

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def pick(k: Column, *values: str | None) -> Column:
    """One of the values, by a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def joined(value: Column, order: Column, by: str) -> Column:
    """An aggregate: the texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"]), by)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, doc_id (the same as text), turn, role and text on one line."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ")
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("conv_id").cast("string").alias("doc_id"), "turn", "role", text.alias("text"))


# Captions


def caption_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WebVTT file of each conversation: cues of several lines, tags, references, and even turns told twice."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")

    def cue(second: Column, n: int) -> Column:
        stamp = F.format_string("00:%02d:%02d.500", F.floor(second / 60), second % 60)
        return F.concat(F.col("turn").cast("string"), F.lit(f"-{n}\n"), stamp, F.lit(" --> "), stamp, F.lit(" align:start\n<c.one>A &amp; B:</c>\n"), F.col("text"), F.lit("\n\n"))

    once, twice = cue(F.col("turn") * 10, 1), cue(F.col("turn") * 10 + 1, 2)
    body = t.withColumn("_cue", F.when(F.col("turn") % 2 == 0, F.concat(once, twice)).otherwise(once))
    return body.groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(F.concat(F.lit("WEBVTT\nKind: captions\n\nNOTE made\n\n"), joined(F.col("_cue"), F.col("turn"), "")).alias("text"))


@query
def webvtt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = RD.parse_vtt(RD.lines_of(caption_files(spark, sf_dir)))
    return cues.select("doc_id", F.col("cue_no").cast("long").alias("cue_no"), (F.col("start_s") * 1000).cast("long").alias("start_ms"), "text")


@query
def caption_service_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of a caption service, each third blank."""
    snippet = F.struct("turn", (F.col("turn") * 2.5).alias("start"), F.when(F.col("turn") % 3 == 2, " ").otherwise(F.col("text")).alias("text"))
    one = turns(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(snippet)), lambda s: F.struct(s["start"].alias("start"), s["text"].alias("text"))).alias("snippets"))
    cues = RD.caption_cues(one)
    return cues.select("doc_id", F.col("cue_no").cast("long").alias("cue_no"), (F.col("start_s") * 1000).cast("long").alias("start_ms"), "text")


@query
def line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with line ends of eight kinds, by their id."""
    ends = ("\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\u2028")
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), pick(F.col("doc_id"), *ends)).alias("text"))
    return RD.lines_of(d).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"), F.max_by("text", "line_no").alias("last_line"))


@query
def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of four kinds by document: its text, a NUL before it, control characters, a NUL behind the sample."""
    k = F.col("doc_id")
    control = F.concat(F.expr("repeat(char(1), cast(doc_id % 10 as int))"), F.lit("aaaaaaaaaa"))
    content = F.when(k % 4 == 0, F.coalesce("text", F.lit(""))).when(k % 4 == 1, F.concat(F.lit("\0"), F.coalesce("text", F.lit("")))).when(k % 4 == 2, control).otherwise(F.concat(F.expr("repeat('a', 9000)"), F.lit("\0")))
    return table(spark, sf_dir, "documents").select("doc_id", RD.looks_binary(F.encode(content, "utf-8")).alias("binary"))


@query
def adjacent_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/m/"), F.col("doc_id").cast("string")).alias("stem"))
    media = d.select(F.concat("stem", F.lit(".mp3")).alias("path"))
    jsons = d.filter("doc_id % 2 = 0").select(F.concat("stem", F.lit(".json")).alias("path"), F.when(F.col("doc_id") % 4 == 0, '{"segments": [{"text": "x"}]}').otherwise('{"text": "x"}').alias("content"))
    return RD.adjacent_json(media, jsons).select("path", "json_path")


# Speech recognition


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload of each conversation: segments at three places, plain text at two, or no JSON, by its id."""
    start = (F.col("turn") * 7).cast("string")
    named = F.struct("turn", start.alias("start"), F.col("role").alias("speaker"), F.col("text").alias("transcript"))
    bare = F.struct("turn", start.alias("start_time"), F.col("text").alias("content"))
    own = turns(spark, sf_dir).groupBy("conv_id", "doc_id").agg(F.array_sort(F.collect_list(named)).alias("n"), F.array_sort(F.collect_list(bare)).alias("b"), F.min_by("text", "turn").alias("first"))
    bodies = [
        F.to_json(F.struct(F.col("n").alias("utterances"))),
        F.to_json(F.struct(F.col("b").alias("segments"))),
        F.to_json(F.struct(F.struct(F.col("n").alias("utterances")).alias("results"))),
        F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.struct(F.col("first").alias("transcript"))).alias("alternatives"))).alias("channels")).alias("results"))),
        F.to_json(F.struct(F.col("first").alias("text"))),
        F.lit("no json"),
    ]
    content = bodies[-1]
    for k, body in enumerate(bodies[:-1]):
        content = F.when(F.col("conv_id") % 6 == k, body).otherwise(content)
    return own.select("doc_id", content.alias("content"))


@query
def recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(RD.recognised_lines(payloads(spark, sf_dir)), "line_no")


@query
def recognised_speaker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(RD.recognised_lines(payloads(spark, sf_dir), speakers=True), "line_no")


@query
def diarized_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diarized payloads as turns, written as transcripts."""
    return WR.turns_to_markdown(RD.diarized_turns(payloads(spark, sf_dir)))


@query
def payload_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = RD.segments_of(payloads(spark, sf_dir))
    return segments.groupBy("doc_id").agg(F.count("*").alias("segments"), F.count("speaker").alias("named"), F.sum("start_s").cast("long").alias("starts"), F.sum(F.length("text")).alias("chars"))


@query
def shifted_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pieces of ten minutes, three of them a recording."""
    t = turns(spark, sf_dir)
    pieces = t.select(F.col("doc_id").alias("piece_id"), F.floor(F.col("conv_id") / 3).alias("doc_id"), (F.col("conv_id") % 3).alias("piece_no"), (F.col("conv_id") % 3 * 600.0).alias("offset_s")).distinct()
    segments = t.select(F.col("doc_id").alias("piece_id"), F.col("turn").alias("seg_no"), (F.col("turn") * 7.0).alias("start_s"), F.col("role").alias("speaker"), "text")
    return longs(RD.shifted(pieces, segments), "seg_no", "start_s")


# Metadata


@query
def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters given (one of them without a title), told in a description, or told once, which is none."""
    t, k = turns(spark, sf_dir), F.col("conv_id") % 3
    given = F.struct("turn", (F.col("turn") * 75.5).alias("start_time"), F.when(F.col("turn") == 1, " ").otherwise(F.concat("role", F.lit("  "), F.col("turn").cast("string"))).alias("title"))
    told = F.concat(F.format_string("%d:%02d ", F.col("turn"), F.col("turn") * 3), F.col("role"), F.lit(" told"))
    one = t.groupBy("conv_id", "doc_id").agg(F.array_sort(F.collect_list(given)).alias("g"), joined(told, F.col("turn"), "\nmore: 1:30 no\n").alias("d"))
    chosen = F.when(k == 0, F.transform("g", lambda c: F.struct(c["start_time"].alias("start_time"), c["title"].alias("title"))))
    return longs(RD.chapters_of(one.select("doc_id", chosen.alias("chapters"), F.when(k == 1, F.col("d")).when(k == 2, "0:00 once\nno 1:00 time").alias("description"))), "chapter_no", "seconds")


@query
def video_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    url = F.when(k % 5 == 4, F.concat(F.lit("https://a.b/"), k.cast("string"))).otherwise(F.concat(F.lit("https://youtu.be/"), F.lpad(k.cast("string"), 11, "v"), F.lit("?t=1")))
    content = F.when(k % 3 == 0, F.concat(F.lit('{"id": "i'), k.cast("string"), F.lit('", "title": "T '), k.cast("string"), F.lit('"}'))).when(k % 3 == 1, F.concat(F.lit('{"id": "i'), k.cast("string"), F.lit('"}'))).otherwise("{broken")
    return RD.video_metadata(table(spark, sf_dir, "pages").select(url.alias("url"), content.alias("content")))


@query
def best_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kinds = ("api", "subtitles", "youtube-transcript-api", "existing", "other", "subtitles-downloaded")
    return RD.best_source(e.select(F.col("user_id").alias("doc_id"), pick(F.floor(F.col("event_id") / 2), *kinds).alias("kind"), (F.col("event_id") % 4 > 1).alias("ok"))).select("doc_id", "kind")


@query
def prior_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return RD.prior_bundle(e.select(F.col("user_id").alias("video_id"), F.col("event_id").cast("string").alias("path"), (F.col("event_id") % 3 == 0).alias("has_transcript"), (F.col("event_id") * 7 % 10).alias("modified")))


@query
def source_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of documents as recordings: who may speak, and the lines that tell so."""
    k = F.col("doc_id")
    names = [pick(k, "@Ann Lee", None, "creator", "Speaker 3", ""), pick(k, "ann lee", "Bob Ray", None), pick(k, "Chan | ", "12:30", "Bob Ray", None), pick(k, None, "Art Ist")]
    handle = pick(k, None, "@handle", "-")
    d = table(spark, sf_dir, "documents").select("doc_id", *[n.alias(c) for n, c in zip((*names, handle), ("creator", "uploader", "channel", "artist", "handle"), strict=True)])
    author = X.author_hint(*[F.col(c) for c in ("creator", "uploader", "channel", "artist", "handle")], unescaped=False)
    candidates = X.speaker_candidates(*[F.col(c) for c in ("creator", "uploader", "channel", "artist")], unescaped=False)
    own = d.withColumns({"author": author, "candidates": candidates})
    return own.select("doc_id", "author", F.array_join("candidates", "|").alias("candidates"), F.size(X.source_hint_lines(F.col("author"), F.col("candidates"), F.col("channel"), F.col("uploader"), F.col("handle"))).cast("long").alias("lines"))


# Work folders


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest file of each user's events, of one of two generations; cells of the second are quoted."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    new = F.concat_ws("\t", F.concat(F.lit("b"), n), F.col("event_type"), F.lit("Ann Lee; Bob"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.lit("00:10")))
    old = F.concat_ws("\t", F.concat(F.lit('"T ""'), n, F.lit('"""')), F.lit("1:00"), F.concat(F.lit("b"), n))
    row = F.when(F.col("user_id") % 2 == 0, new).otherwise(old)
    one = e.groupBy("user_id").agg(joined(row, F.col("event_id"), "\n").alias("rows"))
    header = F.when(F.col("user_id") % 2 == 0, "block_file\ttopic\tnames\ttimestamp_start\n").otherwise("title\tstart_time\tblock_file\tcase_title\n")
    path = F.concat(F.lit("/w/"), F.col("user_id").cast("string"), F.lit("/manifest_chunk_"), X.chunk_label(F.col("user_id")), F.lit(".tsv"))
    return one.select(path.alias("doc_id"), F.concat(header, F.col("rows"), F.lit("\n\n")).alias("text"))


@query
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = RD.manifests_of(RD.lines_of(manifest_files(spark, sf_dir)))
    return rows.select("doc_id", "chunk_id", F.col("row_no").cast("long").alias("row_no"), "block_file", "topic", "names", "timestamp_start", "case_title")


@query
def merged_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    topic = F.when(F.col("event_id") % 10 == 0, "a\tb\nc").when(F.col("event_id") % 7 > 0, F.col("event_type"))
    m = e.select(F.col("user_id").alias("work_id"), X.chunk_label(F.col("event_id") % 60).alias("chunk_id"), F.col("event_id").alias("row_no"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("block_file"), topic.alias("topic"))
    return WR.manifest_tsv(m).select("work_id", F.sha2("tsv", 256).alias("sha256"), F.length("tsv").cast("long").alias("chars"))


def block_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks of ten works; some without front matter, some under other names."""
    k = F.col("doc_id")
    name = F.when(k % 7 == 6, F.concat(F.lit("note_"), k.cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("chunk_"), X.chunk_label(k % 60), F.format_string("_block_%02d.md", k)))
    matter = F.concat(F.lit('---\ntimestamp_start: "00:10"\ntimestamp_end: '), k.cast("string"), F.lit(':20\ntopic: "Topic '), k.cast("string"), F.lit('"\n---\n'))
    text = F.concat(F.when(k % 5 == 4, "").otherwise(matter), F.coalesce("text", F.lit("none")))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("/w/"), (k % 10).cast("string"), F.lit("/"), name).alias("doc_id"), text.alias("text"))


@query
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = RD.blocks_of(block_files(spark, sf_dir))
    return b.select("work_id", "chunk_id", F.col("block_no").cast("long").alias("block_no"), "ts_start", "ts_end", "topic", F.sha2("body", 256).alias("body_sha256"))


@query
def speaker_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker files: a line for each turn, mapped, unmarked, a comment or something else."""
    n = F.col("turn").cast("string")
    line = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("  Speaker "), n, F.lit(" →  "), F.col("role"), F.lit(" "))).when(F.col("turn") % 4 == 1, F.concat(F.lit("# Speaker "), n, F.lit(" → no"))).when(F.col("turn") % 4 == 2, F.concat(F.lit("Unmarked lines (part "), n, F.lit(") → "), F.col("role"))).otherwise(F.concat(F.lit("Speaker "), n, F.lit(": no arrow")))
    files = turns(spark, sf_dir).groupBy("doc_id").agg(F.concat(F.lit("NOTE: Speaker 9 → no\n\n"), joined(line, F.col("turn"), "\n")).alias("text"))
    return RD.speaker_map_of(RD.lines_of(files))


def conversation_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The plan, file meta and works of conversations, each a work of its own."""
    lines = conversation_lines(spark, sf_dir)
    meta = LN.file_meta(lines).withColumn("work_id", F.col("doc_id"))
    works = PL.classified(meta)
    plan = PL.planned(meta, lines)
    told = works.select("work_id", F.col("work_id").alias("doc_id"), F.col("speaker_stage").alias("stage"), F.col("speaker_reason").alias("reason"), F.col("content_mode").alias("mode"), PL.prescan_limit(F.col("speaker_stage")).alias("prescan_limit"), X.mmss("duration_seconds").alias("duration"))
    return plan, meta, told


@query
def prepare_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, meta, works = conversation_plan(spark, sf_dir)
    return WR.prepare_report(plan, meta, works)


@query
def prepare_report_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written and read again."""
    plan, meta, works = conversation_plan(spark, sf_dir)
    texts = WR.prepare_report(plan, meta, works).select(F.col("work_id").alias("doc_id"), F.col("report").alias("text"))
    return longs(RD.prepare_reports(texts), "files", "total_lines", "unique_speakers", "total_chunks")


@query
def prescan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = conversation_lines(spark, sf_dir)
    hints = lines.select("doc_id").distinct().select("doc_id", F.when(F.col("doc_id").endswith("3"), F.array(F.lit("hint one"), F.lit("hint two"))).otherwise(F.array().cast("array<string>")).alias("hint_lines"))
    return WR.prescan_text(LN.prescan(lines, 40), hints)


@query
def prompt_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of every prompt of conversations as works, read back from the prompts."""
    plan, _, works = conversation_plan(spark, sf_dir)
    own = works.join(plan.groupBy("work_id").agg(F.count("*").alias("total_chunks")), "work_id")
    seconds = F.lit(0)
    contract = CT.note_contract(own.select("work_id", F.col("mode").alias("content_mode"), PL.execution_mode(F.col("total_chunks"), F.col("mode"), seconds).alias("execution_mode"), seconds.alias("duration_seconds"), "total_chunks", F.lit("Ann Lee").alias("author_hint")))
    seeds = contract.select("work_id", F.lit("Topic x").alias("topic_hint"), F.lit("10:00").alias("duration_estimate"), "author_hint", F.when(F.col("work_id").endswith("1"), "abcdefghijk").alias("video_id"), F.array("work_id").alias("source_files"))
    prompts = PR.prompt_packs(plan, contract, seeds)

    def told(key: str) -> Column:
        return F.regexp_extract("prompt", f"(?m)^{key}: (.*)$", 1)

    return prompts.select("work_id", "stage", "chunk_id", told("EXTRACTION ZONE").alias("zone"), told("CONTEXT ZONE").alias("context"), told("MODE").alias("mode"), told("MIN BLOCKS").alias("min_blocks"), told("THESES").alias("theses"), told("TAKEAWAYS").alias("takeaways"), F.regexp_extract("prompt", r"(?m)^\*\*Источник:\*\* (.*)$", 1).alias("source"), F.regexp_extract("prompt", r"(?m)^\*\*Формат:\*\* (.*)$", 1).alias("format"))


@query
def assembled_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of sources: documents as blocks, some without header, take-aways or appendix."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    body = F.concat(F.lit("## Block "), k.cast("string"), F.lit(" | 00:10–00:20 | Topic "), k.cast("string"), F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, 20), F.lit(".\n\n---\n \n"))
    own = d.select(F.col("source").alias("work_id"), X.chunk_label(k % 60).alias("chunk_id"), k.alias("block_no"), body.alias("body"))
    n = F.length("source")
    works = d.select("source").distinct().select(F.col("source").alias("work_id"), F.concat(F.lit("Title "), "source").alias("title"), F.when(n % 2 == 0, "# Header\n\n> x\n").alias("header"), F.when(F.col("source").endswith("1"), "1. a\n2. b\n").alias("tldr"), F.when(~F.col("source").endswith("2"), "# Appendix\n").alias("appendix"))
    notes = WR.assembled_notes(works, own)
    return notes.select("work_id", F.length("note").cast("long").alias("chars"), F.sha2("note", 256).alias("sha256"))


@query
def linked_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    text = F.concat(F.lit("## T "), F.format_string("%d:%02d", k, k % 60), F.lit(" and 1:02:03.\nplain 2:03\n## none\n### third 1:00"))
    url = F.when(k % 2 == 0, "https://youtu.be/x").otherwise("https://a.b/w?v=x")
    return table(spark, sf_dir, "documents").select("doc_id", WR.linked_times(text, url).alias("text"))


@query
def json_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' ids and languages appended to a log of JSON lines twice, and read again."""
    from colloquy.plans.views import scratch

    folder = scratch(spark, "jsonl")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    WR.write_json(d.filter("doc_id % 2 = 0"), folder)
    WR.append_jsonl(d.filter("doc_id % 2 = 1"), folder)
    return spark.read.schema("doc_id long, lang string").json(folder)


# The trace


@query
def stamped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    own = e.select("event_id", (F.col("user_id") % 7).alias("bundle_id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("r"), F.col("event_id").cast("string"))).alias("run_id"), F.when(F.col("event_id") % 4 == 0, "n").alias("note_id"))
    active = spark.range(5).select(F.col("id").alias("bundle_id"), F.concat(F.lit("run"), F.col("id").cast("string")).alias("active_run_id"), F.concat(F.lit("note"), F.col("id").cast("string")).alias("active_note_id"))
    return TR.stamped(own, active)


@query
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(pick(F.col("event_id"), "batch.file.", "batch.", "batch.file."), "event_type").alias("event"))
    return TR.batch_progress(e)


@query
def latest_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("ts", F.concat(F.lit("stage."), "event_type").alias("event"), F.col("user_id").cast("string").alias("note_id"), (F.col("event_id") * 7).alias("duration_ms"))
    return TR.latest_stage(e).select("note_id", "event", "duration_ms")
