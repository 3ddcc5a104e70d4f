"""Sources: transcripts, captions, speech-recognition JSON, manifests, blocks and logs as DataFrames.

Everything handles many documents at once. Files come through Spark's readers, so that any store works; order is a
column (line_no, cue_no, ...), never the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.functions import text as X
from colloquy.sources import delimited as D
from colloquy.sources import schemas as S

# Text


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), text, bytes and modified of whole files; bytes that aren't UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("doc_id"), replacing_decode(F.col("content")).alias("text"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def replacing_decode(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def lines_of(texts: DataFrame, doc_id: str = "doc_id", text: str = "text", beside: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, line_no (from 1) and text of each line, and columns of the text's row beside them."""
    each = texts.select(F.col(doc_id).alias("doc_id"), *beside, F.posexplode(X.split_lines(text)).alias("_pos", "_line"))
    return each.select("doc_id", (F.col("_pos") + 1).cast("int").alias("line_no"), F.col("_line").alias("text"), *beside)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines_of(read_texts(spark, path))


#: NUL to US and DEL but tab, line feed and carriage return.
CONTROL = "".join(chr(i) for i in [*range(32), 127] if i not in (9, 10, 13))


def looks_binary(content: Column, sample: int = 8192) -> Column:
    """Whether bytes hold a NUL or over 30 % control characters in their first `sample`."""
    head = F.decode(F.substring(content, 1, sample), "ISO-8859-1")  # a character for each byte
    n = F.length(head)
    control = n - F.length(F.translate(head, CONTROL, ""))
    return F.coalesce((n > 0) & (head.contains("\0") | (control / F.greatest(n, F.lit(1)) > 0.3)), F.lit(False))


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """path, bytes, modified and extension of a folder's files, not of folders within; content isn't read. Empty files are left out, as by all of Spark's readers."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    files = files.withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)))
    return files.filter(F.col("extension").isin(*extensions)) if extensions else files


def adjacent_json(media: DataFrame, jsons: DataFrame) -> DataFrame:
    """Media files with the transcript JSON beside them (same path but for the extension) that has segments."""

    def stem(c: str) -> Column:
        return F.regexp_replace(c, r"\.[^./]*$", "")

    usable = jsons.filter(F.get_json_object("content", "$.segments").isNotNull()).select(stem("path").alias("_stem"), F.col("path").alias("json_path"), "content")
    return media.join(usable, stem("path") == F.col("_stem"), "left").drop("_stem")


# Captions


def parse_vtt(lines: DataFrame) -> DataFrame:
    """The cues of WebVTT files: start, text; a cue equal to the one before it is left out.

    A file falls into runs of lines that aren't blank; the first timing in a run starts a cue, and what follows in the
    run is its text.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    stripped = lines.withColumn("_t", X.strip("text"))
    run = stripped.withColumn("_run", F.sum((F.col("_t") == "").cast("int")).over(w)).filter("_t <> ''")
    skipped = F.col("_t").isin("WEBVTT") | X.starts_with_any(L.VTT_SKIPPED, F.col("_t"))
    timing = F.when(~skipped & F.col("_t").rlike(L.VTT_TIMING), F.struct("line_no", F.regexp_extract("_t", L.VTT_TIMING, 1).alias("start")))
    run = run.withColumn("_timing", F.min(timing).over(Window.partitionBy("doc_id", "_run")))
    cues = run.filter("_timing is not null and line_no >= _timing.line_no").groupBy("doc_id", "_run").agg(
        F.first("_timing").alias("_timing"), F.array_sort(F.collect_list(F.when(F.col("line_no") > F.col("_timing.line_no"), F.struct("line_no", "text")))).alias("_lines")
    )
    cues = cues.select("doc_id", F.col("_timing.line_no").alias("_at"), X.vtt_seconds("_timing.start").alias("start_s"), X.clean_caption(F.col("_lines.text")).alias("text"))
    return numbered(without_repeats(cues.filter("text <> ''"), "_at"), "_at", "cue_no").select("doc_id", "cue_no", "start_s", "text")


def without_repeats(rows: DataFrame, order: str, text: str = "text") -> DataFrame:
    """rows without those whose text equals the one before in the document."""
    w = Window.partitionBy("doc_id").orderBy(order)
    return rows.withColumn("_before", F.lag(text).over(w)).filter(~F.col(text).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")


def numbered(rows: DataFrame, order: str, name: str, by: str = "doc_id") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(order)))


def caption_cues(snippets: DataFrame) -> DataFrame:
    """Cues of a caption service's JSON (doc_id, snippets array<struct<start, text>>) without blank ones."""
    one = snippets.select("doc_id", F.posexplode("snippets").alias("_pos", "s"))
    return one.filter(X.strip("s.text") != "").select("doc_id", (F.col("_pos") + 1).alias("cue_no"), F.col("s.start").cast("double").alias("start_s"), F.col("s.text").alias("text"))


def subtitle_totals(cues: DataFrame) -> DataFrame:
    """doc_id, cues and chars of caption files."""
    return cues.groupBy("doc_id").agg(F.count("*").alias("cues"), F.sum(F.length("text")).alias("chars"))


def subtitles_usable(cues: Column, chars: Column, seconds: Column) -> Column:
    """Whether captions hold enough; short recordings (up to 300 s) need less, an unknown length counts as long."""
    short = F.coalesce(seconds <= 300, F.lit(False))
    return F.when(short, (cues >= 2) & (chars >= 20)).otherwise((cues >= 20) & (chars >= 400))


def best_subtitles(cues: DataFrame, files: DataFrame) -> DataFrame:
    """Of a recording's caption files (doc_id, work_id, name, seconds) the best usable one: Russian, English, then others; the longest; by name."""
    language = X.subtitle_language("name")
    rank = F.when(language == "ru", 0).when(language == "en", 1).otherwise(2)
    own = files.join(subtitle_totals(cues), "doc_id").filter(subtitles_usable(F.col("cues"), F.col("chars"), F.col("seconds")))
    best = own.groupBy("work_id").agg(F.min(F.struct(rank.alias("rank"), (-F.col("chars")).alias("less"), "name", "doc_id", language.alias("language"))).alias("b"))
    return best.select("work_id", F.col("b.doc_id").alias("doc_id"), F.col("b.name").alias("name"), F.col("b.language").alias("language"), (-F.col("b.less")).alias("chars"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


# Speech recognition

_SEGMENT = "struct<start:string,start_time:string,timestamp:string,speaker:string,transcript:string,text:string,content:string>"
PAYLOAD = f"struct<text:string,transcript:string,language:string,utterances:array<{_SEGMENT}>,segments:array<{_SEGMENT}>,results:struct<utterances:array<{_SEGMENT}>,segments:array<{_SEGMENT}>,channels:array<struct<alternatives:array<struct<transcript:string>>>>>>"


def tolerant_json(content: Column, schema: str) -> Column:
    """A JSON object by schema; null for what isn't one."""
    return F.when(X.strip(content).startswith("{") & F.try_parse_json(content).isNotNull(), F.from_json(content, schema, {"mode": "PERMISSIVE"}))


def segments_of(payloads: DataFrame, content: str = "content") -> DataFrame:
    """Segments of any of the known payloads, in their order: utterances, segments, and those in results."""
    p = payloads.select("doc_id", tolerant_json(F.col(content), PAYLOAD).alias("p"))
    none = F.array().cast(f"array<{_SEGMENT}>")
    lists = [F.coalesce(F.col(c), none) for c in ("p.utterances", "p.segments", "p.results.utterances", "p.results.segments")]
    one = p.select("doc_id", F.posexplode(F.concat(*lists)).alias("_pos", "s"))
    text = X.strip(X.first_filled(F.col("s.transcript"), F.col("s.text"), F.col("s.content")))
    start = F.coalesce(F.col("s.start"), F.col("s.start_time"), F.col("s.timestamp"), F.lit("0")).try_cast("double")
    out = one.select("doc_id", "_pos", F.coalesce(start, F.lit(0.0)).alias("start_s"), F.col("s.speaker").alias("speaker"), text.alias("text")).filter("text <> ''")
    return numbered(out, "_pos", "seg_no").select("doc_id", "seg_no", "start_s", "speaker", "text")


def fallback_text(content: Column) -> Column:
    """The plain text of a payload without segments; null without any."""
    p = tolerant_json(content, PAYLOAD)
    first = F.try_element_at(p["results"]["channels"], F.lit(1))
    words = [p["text"], p["transcript"], F.try_element_at(first["alternatives"], F.lit(1))["transcript"]]
    return F.coalesce(*[X.blank_to_null(X.strip(c)) for c in words])


def recognised_lines(payloads: DataFrame, speakers: bool = False) -> DataFrame:
    """doc_id, line_no, text, error: transcript lines of speech-recognition JSON.

    `*MM:SS* text`; with speakers and more than one of them, `**Speaker x** *MM:SS* text`. Without segments the payload's
    text at 00:00 (as it is, with speakers); a payload without either gives one row with an error.
    """
    segments = segments_of(payloads)
    many = F.size(F.collect_set("speaker").over(Window.partitionBy("doc_id"))) > 1
    stamp = F.concat(F.lit("*"), X.mmss("start_s"), F.lit("* "), F.col("text"))
    named = F.concat(F.lit("**Speaker "), F.col("speaker"), F.lit("** "), stamp)
    own = segments.select("doc_id", F.col("seg_no").alias("line_no"), (F.when(many & F.col("speaker").isNotNull(), named).otherwise(stamp) if speakers else stamp).alias("text"), F.lit(None).cast("string").alias("error"))
    rest = payloads.join(segments.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("_t", fallback_text(F.col("content")))
    plain = F.col("_t") if speakers else F.concat(F.lit("*00:00* "), F.col("_t"))
    error = F.when(F.col("_t").isNull(), "no segments or text")
    return own.unionByName(rest.select("doc_id", F.lit(1).alias("line_no"), plain.alias("text"), error.alias("error")))


def diarized_turns(payloads: DataFrame, fold: bool = True) -> DataFrame:
    """Turns of diarized JSON: speakers numbered from 1 in their order, consecutive segments of one speaker folded."""
    segments = segments_of(payloads)
    names = segments.filter("speaker <> ''").select("doc_id", "speaker").distinct()
    names = names.withColumn("_n", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("speaker")))
    named = segments.join(names, ["doc_id", "speaker"], "left").withColumn("speaker", F.concat(F.lit("Speaker "), F.coalesce("_n", F.lit(1)).cast("string")))
    return folded(named) if fold else named.select("doc_id", F.col("seg_no").alias("utt_no"), "speaker", "text", X.mmss("start_s").alias("ts"))


def folded(segments: DataFrame) -> DataFrame:
    """Islands of consecutive segments with one speaker, as one turn each with the first start."""
    w = Window.partitionBy("doc_id").orderBy("seg_no")
    island = F.sum(F.coalesce((F.col("speaker") != F.lag("speaker").over(w)).cast("int"), F.lit(1))).over(w)
    return segments.withColumn("utt_no", island).groupBy("doc_id", "utt_no").agg(
        F.first("speaker").alias("speaker"), joined_in_order("text", "seg_no", " ").alias("text"), X.mmss(F.min_by("start_s", "seg_no")).alias("ts")
    )


def words_to_turns(words: DataFrame) -> DataFrame:
    """Words (doc_id, word_no, type, speaker, text, start_s) grouped by change of speaker; only type `word` counts."""
    own = words.filter("type = 'word'").withColumnRenamed("word_no", "seg_no")
    return folded(own.withColumn("speaker", F.coalesce("speaker", F.lit(""))))


def joined_in_order(text: str, order: str, by: str) -> Column:
    """An aggregate: the texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), by)


def shifted(pieces: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments of pieces of one recording, put together: each start moved by its piece's offset."""
    both = segments.join(pieces.select("piece_id", "doc_id", "piece_no", "offset_s"), "piece_id")
    both = both.withColumn("start_s", F.col("start_s") + F.col("offset_s"))
    return both.withColumn("seg_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("piece_no", "seg_no"))).select("doc_id", "seg_no", "start_s", "speaker", "text")


# Metadata


def chapters_of(metadata: DataFrame) -> DataFrame:
    """Chapters (doc_id, chapters array<struct<start_time, title>>, description): the structured ones, else at least two lines of the description that start with a time."""
    given = F.filter(F.transform(F.coalesce("chapters", F.array().cast("array<struct<start_time:double,title:string>>")), lambda c: F.struct(c["start_time"].cast("int").alias("seconds"), X.strip(F.coalesce(c["title"], F.lit(""))).alias("title"))), lambda c: c["seconds"].isNotNull() & (c["title"] != ""))
    given = F.transform(given, lambda c: F.struct(F.format_string("%d:%02d", F.floor(c["seconds"] / 60), c["seconds"] % 60).alias("timestamp"), c["title"].alias("title"), c["seconds"].alias("seconds")))
    pattern = r"(?m)^(\d{1,2}:\d{2}(?::\d{2})?)\s+(.+)$"
    text = F.coalesce("description", F.lit(""))
    told = F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("t"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("n")), lambda z: F.struct(z["t"].alias("timestamp"), X.strip(z["n"]).alias("title"), X.duration_seconds(z["t"]).cast("int").alias("seconds")))
    chosen = F.when(F.size(given) > 0, given).when(F.size(told) >= 2, told)
    return metadata.select("doc_id", F.posexplode(chosen).alias("_pos", "c")).select("doc_id", (F.col("_pos") + 1).alias("chapter_no"), "c.timestamp", "c.title", "c.seconds")


def video_metadata(landed: DataFrame) -> DataFrame:
    """Metadata (url, content JSON) with the id from the JSON, else from the URL with a warning; rows with neither go."""
    p = F.when(F.try_parse_json("content").isNotNull(), F.col("content"))
    told = F.get_json_object(p, "$.id")
    out = landed.select("url", F.coalesce(told, X.video_id("url")).alias("id"), F.coalesce(F.get_json_object(p, "$.title"), told, X.video_id("url")).alias("title"), F.when(told.isNull(), "metadata missing; id from URL").alias("warning"))
    return out.filter("id is not null")


def best_source(candidates: DataFrame) -> DataFrame:
    """Of a document's transcript candidates (doc_id, kind, ok) the first kind that succeeded."""
    order = ("existing", "youtube-transcript-api", "subtitles", "subtitles-downloaded", "api")
    rank = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    w = Window.partitionBy("doc_id").orderBy(rank, "kind")
    return candidates.filter("ok").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def prior_bundle(bundles: DataFrame) -> DataFrame:
    """Of a video's bundles (video_id, path, has_transcript, modified) the newest, one with a transcript first."""
    w = Window.partitionBy("video_id").orderBy(F.desc("has_transcript"), F.desc("modified"), "path")
    return bundles.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


# Work folders


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest TSV files of any generation, by the names in their headers; columns that a file lacks are null.

    Each file is parsed by its own header, so that files of several generations can be read at once.
    """
    return manifests_of(D.raw_lines(read_texts(spark, path)))


def manifests_of(lines: DataFrame) -> DataFrame:
    """As read_manifest, of lines that are landed already; doc_id is the file's path."""
    rows = D.by_name(lines, {c: S.MANIFEST_ALIASES.get(c, (c,)) for c in S.MANIFEST_COLUMNS})
    return rows.withColumn("chunk_id", F.regexp_extract("doc_id", r"manifest_chunk_([A-Za-z0-9]+)\.tsv$", 1)).select("doc_id", "chunk_id", "row_no", *S.MANIFEST_COLUMNS)


def manifest_columns(rows: DataFrame) -> DataFrame:
    """The columns of all manifest generations from a map of names to cells (m); aliases fill what is empty."""
    out = []
    for name in S.MANIFEST_COLUMNS:
        found = F.coalesce(*[X.blank_to_null(F.try_element_at("m", F.lit(a))) for a in S.MANIFEST_ALIASES.get(name, (name,))])
        out.append(found.alias(name))
    return rows.select(*[c for c in rows.columns if c != "m"], *out)


def blocks_of(texts: DataFrame) -> DataFrame:
    """Block files: work_id, chunk_id, block_no, ts_start, ts_end, topic and the body without front matter."""
    name = r"chunk_([A-Za-z0-9]+)_block_(\d+)\.md$"
    matter, body = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---\n(.*)$", 1), F.regexp_extract("text", r"(?s)^---\n(.*?)\n---\n(.*)$", 2)

    def field(key: str) -> Column:
        return X.blank_to_null(F.regexp_extract(matter, rf'(?m)^{key}:\s*"?(.*?)"?\s*$', 1))

    return texts.select(
        F.regexp_replace("doc_id", r"/[^/]*$", "").alias("work_id"), F.regexp_extract("doc_id", name, 1).alias("chunk_id"), F.regexp_extract("doc_id", name, 2).cast("int").alias("block_no"),
        field("timestamp_start").alias("ts_start"), field("timestamp_end").alias("ts_end"), field("topic").alias("topic"), F.coalesce(X.blank_to_null(body), F.col("text")).alias("body"),
    ).filter("chunk_id <> ''")


def speaker_map_of(lines: DataFrame) -> DataFrame:
    """Mappings of speaker files: work_id, pattern, replacement."""
    pattern = r"(?U)^(Speaker\s+\d+|Unmarked\s+(?:lines|speaker)(?:\s*\([^)]*\))?)\s*→\s*(.+)"
    text = X.strip("text")
    own = lines.filter(~(text.startswith("#") | text.startswith("NOTE:"))).select("doc_id", F.regexp_extract(text, pattern, 1).alias("p"), F.regexp_extract(text, pattern, 2).alias("r"))
    return own.select(F.col("doc_id").alias("work_id"), X.strip("p").alias("pattern"), X.strip("r").alias("replacement")).filter("pattern <> '' and replacement <> ''")


def prepare_reports(texts: DataFrame) -> DataFrame:
    """The fields of text reports."""

    def field(pattern: str) -> Column:
        return X.blank_to_null(X.strip(F.regexp_extract("text", f"(?m){pattern}", 1)))

    def number(pattern: str) -> Column:
        return F.coalesce(field(pattern).try_cast("int"), F.lit(0))

    return texts.select(
        "doc_id", field(r"^WORK_DIR:\s*(.+)$").alias("work_dir"), number(r"^Files:\s*(\d+)$").alias("files"), number(r"^Total lines:\s*(\d+)$").alias("total_lines"),
        F.coalesce(field(r"^Duration estimate:\s*(.+)$"), F.lit("unknown")).alias("duration_estimate"), number(r"^Unique speakers:\s*(\d+)$").alias("unique_speakers"),
        number(r"^=== TOTAL CHUNKS:\s*(\d+)\s*===$").alias("total_chunks"),
    )


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.TRACE).json(path)
