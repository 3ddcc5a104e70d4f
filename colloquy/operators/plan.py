"""Classification of recordings and the chunk plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.functions import text as X
from colloquy.operators.digests import ordered_digests
from colloquy.operators.lines import token_estimate, tokens_of, with_sizes, work_totals
from colloquy.sources.shared import kept

MINUTE = 60


def by_stage(required: float, optional: float, skip: float, stage: Column) -> Column:
    return F.when(stage == "required", F.lit(required)).when(stage == "optional", F.lit(optional)).otherwise(F.lit(skip))


def speaker_stage(lines: Column, markers: Column, dialogue: Column, speakers: Column, intros: Column) -> Column:
    """required, skip or optional."""
    several = (markers >= 2) | (dialogue >= 4) | (intros >= 2) | (speakers >= 3)
    weak = (markers <= 1) & (dialogue <= 1) & (speakers <= 1) & (intros <= 1) & (lines < 1200)
    return F.when(several, "required").when(weak, "skip").otherwise("optional")


def speaker_reason(stage: Column) -> Column:
    return F.when(stage == "required", "multiple speaker markers or dialog cues detected").when(stage == "skip", "single-speaker or lecture-style transcript with weak dialog cues and at most one intro cue").otherwise("speaker identification may help, but content can be processed safely without it")


def content_mode(stage: Column, lines: Column, markers: Column, dialogue: Column, speakers: Column, intros: Column, seconds: Column, kind: Column | None = None, author: Column | None = None) -> Column:
    """monologue, workshop or conversation; the first rule that holds."""
    weak = (markers <= 1) & (dialogue <= 1) & (speakers <= 1) & (intros <= 1)
    dense = (markers >= 3) | (dialogue >= 8) | (intros >= 3)
    led = (seconds >= 45 * MINUTE) & ((dialogue >= 5) | (markers >= 2))
    group = (speakers >= 3) & (intros >= 1)
    known = named_video(kind, author) & weak & (seconds <= 45 * MINUTE)
    talk = (stage == "required") | (markers >= 2) | (dialogue >= 3) | (intros >= 2)
    out = F.when(known, "monologue").when((stage == "skip") & weak, "monologue").when(dense | led | group, "workshop").when(talk, "conversation")
    return out.when((lines >= 2200) & (seconds >= 35 * MINUTE), "workshop").otherwise("conversation")


def named_video(kind: Column | None, author: Column | None) -> Column:
    """Whether a recording is a video whose author is known."""
    if kind is None or author is None:
        return F.lit(False)
    return F.coalesce(kind == "youtube", F.lit(False)) & X.is_person(X.person_text(author, unescaped=False))


def effective_stage(stage: Column, mode: Column, kind: Column | None = None, author: Column | None = None) -> Column:
    """The stage after the fast path of monologues."""
    return F.when((mode == "monologue") & (named_video(kind, author) | (stage == "optional")), "skip").otherwise(stage)


def execution_mode(chunks: Column, mode: Column, seconds: Column) -> Column:
    """single, micro-multi or multi."""
    alone = mode == "monologue"
    out = F.when(chunks <= 1, "single").when(alone & (seconds > 0) & (seconds <= 18 * MINUTE) & (chunks <= 2), "single")
    return out.when(alone & (chunks <= 4) & (seconds <= 35 * MINUTE), "micro-multi").when(chunks <= 3, "micro-multi").otherwise("multi")


def tldr_strategy(mode: Column) -> Column:
    return F.when(mode == "single", "inline-extraction").when(mode == "micro-multi", "deterministic-merge").otherwise("agent")


def quick_mode(lines: Column) -> Column:
    return lines < 250


def prescan_limit(stage: Column) -> Column:
    return F.when(stage == "skip", 40).otherwise(200)


def chunks_by_lines(lines: Column, stage: Column) -> Column:
    target = F.greatest(F.lit(350.0), (F.lit(500.0) + lines / 12.0) * by_stage(0.92, 1.0, 1.16, stage))
    n = F.greatest(F.lit(1), F.ceil(lines / target))
    return F.when((lines < 350) & (stage == "skip"), 1).otherwise(F.when(lines >= 500, F.greatest(F.lit(2), n)).otherwise(n)).cast("int")


def chunk_count(lines: Column, stage: Column, seconds: Column, tokens: Column, mode: Column) -> Column:
    """The number of chunks of a file: by lines, raised by tokens and duration, capped by mode."""
    timed = F.when(seconds <= 30 * MINUTE, 2).when(seconds <= 55 * MINUTE, 3).otherwise(4)
    alone = F.when(seconds > 0, timed).otherwise(F.when(lines < 2000, 2).otherwise(3))
    cap = F.when(mode == "monologue", alone).when(lines >= 12000, 12).when(lines >= 8000, 10).otherwise(8)

    def raised(base: Column) -> Column:
        by_tokens = F.least(F.greatest(F.lit(1), F.ceil(tokens / by_stage(2200, 2600, 3000, stage))), base + 1)
        by_time = F.least(F.greatest(F.lit(1), F.ceil(seconds / MINUTE / 20)), base + 2)
        return F.greatest(base, F.when((tokens > 0) & (lines < 2000), by_tokens), F.when(seconds > 0, by_time))

    return F.when(quick_mode(lines), 1).otherwise(F.least(X.let(chunks_by_lines(lines, stage), raised), cap)).cast("int")


def min_blocks(lines: Column, tokens: Column, seconds: Column) -> Column:
    out = None
    for n, minutes, most_lines, most_tokens in L.BLOCK_TIERS:
        test = (seconds >= minutes * MINUTE) | (lines >= most_lines) | (tokens >= most_tokens)
        out = F.when(test, n) if out is None else out.when(test, n)
    return out.otherwise(1)


def target_lines(lines: Column, stage: Column) -> Column:
    return F.greatest(F.lit(650), F.bround((F.lit(1000.0) + lines / 12.0) * by_stage(0.92, 1.0, 1.16, stage), 0).cast("int"))


COUNTS = ("lines", "markers", "dialogue_cues", "dialogue_speakers", "intro_cues")


def with_modes(totals: DataFrame, hints: DataFrame | None) -> DataFrame:
    """totals of works (in columns named as in COUNTS, and duration_seconds) with stage, reason, content mode and effective duration."""
    kind, author, override = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0)
    if hints is not None:
        told = hints.select("work_id", F.col("source_kind").alias("_kind"), F.col("author_hint").alias("_author"), F.col("duration_seconds").alias("_told"))
        totals = totals.join(told, "work_id", "left")
        kind, author, override = F.col("_kind"), F.col("_author"), F.greatest(F.lit(0), F.coalesce(F.col("_told").cast("long"), F.lit(0)))
    counts = [F.col(c) for c in COUNTS]
    own = totals.withColumns({"override_seconds": override, "_stage": speaker_stage(*counts)})
    own = own.withColumn("duration_seconds", F.when(F.col("override_seconds") > 0, F.col("override_seconds")).otherwise(F.col("duration_seconds")))
    own = own.withColumn("content_mode", content_mode(F.col("_stage"), *counts, F.col("duration_seconds"), kind, author))
    own = own.withColumn("speaker_stage", effective_stage(F.col("_stage"), F.col("content_mode"), kind, author))
    return own.withColumn("speaker_reason", speaker_reason(F.col("speaker_stage"))).drop("_stage", "_kind", "_author", "_told")


def classified(meta: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """A row per work: totals, stage, reason, content mode and duration. hints: work_id, source_kind, author_hint, duration_seconds."""
    return with_modes(work_totals(meta), hints)


def classified_files(meta: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """The files of each work with the work's stage, content mode, and their own share of its duration.

    Totals are sums over the work's files in a window, so that the meta isn't computed a second time to be joined.
    """
    w = Window.partitionBy("work_id")
    seconds = X.duration_seconds("duration_estimate")
    own = meta.select("work_id", "doc_id", F.col("lines").alias("_lines"), F.col("estimated_tokens").alias("_tokens"), seconds.alias("_own"), *[F.sum(c).over(w).alias(c) for c in COUNTS])
    last = F.max(F.when(F.col("_own") > 0, F.struct("doc_id", "_own"))).over(w)["_own"]
    modes = with_modes(own.withColumn("duration_seconds", F.coalesce(last, F.lit(0)).cast("long")), hints)
    share = F.bround(F.col("override_seconds") * (F.col("_lines") / F.greatest(F.lit(1), F.col("lines"))), 0).cast("long")
    seconds = F.when(F.col("override_seconds") > 0, share).otherwise(F.col("_own"))
    return modes.select("work_id", "doc_id", F.col("_lines").alias("lines"), F.col("_tokens").alias("estimated_tokens"), seconds.alias("seconds"), "speaker_stage", "content_mode")


def chunked_files(files: DataFrame) -> DataFrame:
    """Files (work_id, doc_id, lines, estimated_tokens, seconds, speaker_stage, content_mode) with their chunks, chunk_size, overlap, and the chunks of the work's files before."""
    n = F.col("lines").cast("int")
    own = files.withColumn("chunks", chunk_count(n, F.col("speaker_stage"), F.col("seconds"), F.col("estimated_tokens"), F.col("content_mode")))
    own = own.withColumn("chunk_size", F.ceil(n / F.col("chunks")).cast("int"))
    before = Window.partitionBy("work_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return own.withColumns({"overlap": F.greatest(F.lit(10), F.least(F.lit(24), F.bround(F.col("chunk_size") * 0.08, 0))).cast("int"), "_before": F.coalesce(F.sum("chunks").over(before), F.lit(0))})


def with_ranges(chunks: DataFrame) -> DataFrame:
    """Rows of chunked files and chunk numbers _k (from 0) with label and ranges; a work's very first chunk has no context."""
    n, size, k = F.col("lines").cast("int"), F.col("chunk_size"), F.col("_k")
    end = F.when(k == F.col("chunks") - 1, n).otherwise(F.least(n, (k + 1) * size)).cast("int")
    own = chunks.withColumns({"_index": F.col("_before") + k, "extraction_start": (k * size + 1).cast("int"), "extraction_end": end, "read_end": end})
    later = F.col("_index") > 0
    from_line = F.greatest(F.lit(1), F.col("extraction_start") - F.col("overlap"))
    return own.withColumns(
        {
            "chunk_id": X.chunk_label(F.col("_index")),
            "context_start": F.when(later, from_line),
            "context_end": F.when(later, F.greatest(F.lit(1), F.col("extraction_start") - 1)),
            "read_start": F.when(later, from_line).otherwise(F.col("extraction_start")),
            "target_lines": target_lines(n, F.col("speaker_stage")),
        }
    )


def chunk_ranges(files: DataFrame) -> DataFrame:
    """The chunks of each file: ranges and labels, which count through all files of a work in their order."""
    return with_ranges(chunked_files(files).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))).drop("_k", "_index", "_before")


def lines_in_chunks(chunked: DataFrame, lines: DataFrame) -> DataFrame:
    """lines with the columns of their chunked file and the number _k of their chunk, by arithmetic on the line's number.

    The files are written first: of known size, they are broadcast where they are few, and lines aren't dealt by their file.
    """
    k = F.least(F.floor((F.col("line_no") - 1) / F.col("chunk_size")), F.col("chunks") - 1).cast("int")
    return lines.join(kept(chunked, "chunked"), "doc_id").withColumn("_k", k)


def chunk_lines(files: DataFrame, lines: DataFrame) -> DataFrame:
    """work_id, doc_id, chunk_id, line_no, text: the lines that each chunk extracts."""
    return with_ranges(lines_in_chunks(chunked_files(files), lines)).select("work_id", "doc_id", "chunk_id", "line_no", "text")


def chunk_plan(files: DataFrame, lines: DataFrame, fingerprints: bool = True) -> DataFrame:
    """The plan: ranges with tokens, duration, least blocks and a fingerprint of each chunk.

    Lines meet their file once and carry its columns to their chunk, so nothing is joined back. Fingerprints are digests of
    lines as they pass in order (`ordered_digests`); no chunk's text is put together.
    """
    chunked = chunked_files(files)
    placed = with_sizes(lines_in_chunks(chunked, lines))
    told = (F.col("_filled"), F.col("_chars"), F.col("_words"))
    if fingerprints:
        parts_of = ["doc_id", "speaker_stage", "extraction_start", "extraction_end", "context_start", "context_end"]
        ranged = with_ranges(placed).withColumns({"_filled": F.col("_chars") > 0, "_head": F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts_of])})
        ranged = ranged.withColumn("_filled", F.col("_filled").cast("int"))
        carried = tuple(c for c in with_ranges(chunked.withColumn("_k", F.lit(0))).columns if c not in ("doc_id", "_k"))
        own = ordered_digests(ranged, ["doc_id", "_k"], "line_no", "text", "_head", ("_filled", "_chars", "_words"), carried)
        own = own.withColumns({"chunk_tokens": tokens_of(*told), "chunk_fingerprint": F.substring("sha256", 1, X.SHORT)})
    else:
        own = with_ranges(placed.groupBy(*chunked.columns, "_k").agg(token_estimate().alias("chunk_tokens")))
    count = F.col("extraction_end") - F.col("extraction_start") + 1
    seconds = F.when(F.col("seconds") > 0, F.bround(F.col("seconds") * (count / F.greatest(F.col("lines"), F.lit(1))), 0)).otherwise(0).cast("long")
    own = own.withColumn("approx_duration_seconds", seconds)
    own = own.withColumn("min_blocks", min_blocks(count, F.col("chunk_tokens"), F.col("approx_duration_seconds")))
    kept = ["work_id", "doc_id", "chunk_id", "context_start", "context_end", "extraction_start", "extraction_end", "read_start", "read_end", "chunk_size", "overlap", F.col("chunk_tokens").alias("estimated_tokens"), "approx_duration_seconds", "min_blocks", "target_lines", "content_mode", "speaker_stage"]
    return own.select(*kept, *(["chunk_fingerprint"] if fingerprints else []))


def planned(meta: DataFrame, lines: DataFrame, hints: DataFrame | None = None, fingerprints: bool = True) -> DataFrame:
    """From file meta (work_id, doc_id, ...) and lines to the plan of each work."""
    return chunk_plan(classified_files(meta, hints), lines, fingerprints)


def fingerprint(files: DataFrame) -> DataFrame:
    """work_id and the fingerprint of its files (doc_id, lines, bytes, modified) in order."""
    row = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("lines").cast("string"), F.col("bytes").cast("string"), F.col("modified").cast("long").cast("string"))
    own = ordered_digests(files.select("work_id", "doc_id", row.alias("row")), ["work_id"], "doc_id", "row")
    return own.select("work_id", F.substring("sha256", 1, X.SHORT).alias("fingerprint"))


def header_seed(works: DataFrame) -> DataFrame:
    """What a header is written from: works has work_id, title_candidates, speaker_stage, duration_estimate, author_hint, speaker_candidates, source_files."""
    author = X.blank_to_null(X.strip(F.coalesce("author_hint", F.lit(""))))
    alone = F.when(author.isNotNull(), F.concat(F.lit("single-speaker (likely "), author, F.lit(")"))).otherwise("single-speaker")
    return works.withColumns(
        {
            "topic_hint": F.coalesce(F.try_element_at("title_candidates", F.lit(1)), F.lit("")),
            "participants_hint": F.when(F.col("speaker_stage") == "skip", alone).otherwise("multi-speaker or interview"),
            "author_hint": author,
        }
    )


def route(source: Column) -> Column:
    """What handles an input: youtube, audio or local."""
    extension = F.lower(F.regexp_extract(source, r"(\.[^./]*)$", 1))
    return F.when(X.is_video_url(source), "youtube").when(extension.isin(*L.AUDIO_EXTENSIONS, *L.VIDEO_EXTENSIONS), "audio").otherwise("local")


def batch_route(source: Column) -> Column:
    """As route for files of a batch; null for what no handler supports."""
    extension = F.lower(F.regexp_extract(source, r"(\.[^./]*)$", 1))
    return F.when(extension.isin(*L.TEXT_EXTENSIONS), "local").when(extension.isin(*L.AUDIO_EXTENSIONS, *L.VIDEO_EXTENSIONS), "audio")
