"""Queries over the driver's tables: each applies operators of the library to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import appendix as AP
from colloquy.operators import contract as CT
from colloquy.operators import lines as LN
from colloquy.operators import plan as PL
from colloquy.operators import quality as QL
from colloquy.operators import speakers as SP
from colloquy.operators import state as ST
from colloquy.operators import tldr as TL
from colloquy.plans import files, landed, notes, streams
from colloquy.plans.fixtures import ACTION_TEXTS, NAMES, TIMES, URLS
from colloquy.plans.views import conversation_lines, doc_lines, source_lines, source_meta, table
from colloquy.sources import readers as RD
from colloquy.sources import writers as WR
from colloquy.streaming import trace as TR

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# Lines and files


@query
def doc_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(doc_lines(spark, sf_dir), "line_no")


@query
def doc_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LN.with_sizes(doc_lines(spark, sf_dir)).groupBy("doc_id").agg(LN.token_estimate().alias("estimated_tokens"))


@query
def source_file_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LN.file_meta(source_lines(spark, sf_dir))


@query
def conversation_file_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LN.file_meta(conversation_lines(spark, sf_dir))


@query
def line_features_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = LN.line_features(conversation_lines(spark, sf_dir))
    return f.groupBy("doc_id", "speaker_name").agg(F.count("*").alias("lines"), F.count_if("is_dialogue").alias("dialogue"), F.count_if("is_clue").alias("clues"), F.sum(F.size("markers")).alias("markers"))


@query
def drop_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = LN.drop_repeated_lines(doc_lines(spark, sf_dir))
    return kept.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


@query
def densest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(LN.densest_window(source_lines(spark, sf_dir), limit=40), "offset", "score")


@query
def clue_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(LN.clue_context(conversation_lines(spark, sf_dir)), "clue_no", "line_no")


@query
def prescan_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four sections of sources and conversations."""
    own = source_lines(spark, sf_dir).unionByName(conversation_lines(spark, sf_dir))
    p = LN.prescan(own, 40)
    return longs(p.groupBy("doc_id", "section", "part").agg(F.count("*").alias("lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.sum(F.length("text")).alias("chars")), "section", "part", "first_line", "last_line")


@query
def topic_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LN.topic_hint(doc_lines(spark, sf_dir))


# Plan


@query
def work_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = PL.classified(source_meta(source_lines(spark, sf_dir)))
    return own.select("work_id", "files", "lines", "estimated_tokens", "markers", "dialogue_cues", "dialogue_speakers", "intro_cues", "duration_seconds", "speaker_stage", "content_mode")


@query
def source_chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = source_lines(spark, sf_dir)
    plan = PL.planned(source_meta(lines), lines)
    return longs(plan, "context_start", "context_end", "extraction_start", "extraction_end", "read_start", "read_end", "chunk_size", "overlap", "min_blocks", "target_lines")


@query
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = source_lines(spark, sf_dir)
    parts = PL.chunk_lines(PL.classified_files(source_meta(lines)), lines)
    return longs(parts.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.sum(F.length("text")).alias("chars")), "first_line", "last_line")


@query
def chunk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.chunk_label(F.col("doc_id")).alias("label"))


@query
def work_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = source_meta(source_lines(spark, sf_dir)).withColumn("modified", F.lit(0))
    return PL.fingerprint(meta)


@query
def conversation_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = PL.classified(LN.file_meta(conversation_lines(spark, sf_dir)).withColumn("work_id", F.col("doc_id")))
    return own.select("work_id", "lines", "markers", "dialogue_cues", "dialogue_speakers", "speaker_stage", "content_mode", PL.execution_mode(F.lit(1), F.col("content_mode"), F.col("duration_seconds")).alias("execution_mode"), PL.prescan_limit(F.col("speaker_stage")).cast("long").alias("prescan_limit"), PL.quick_mode(F.col("lines")).alias("quick"))


@query
def timed_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with times, four of them a work: durations and shares come in."""
    k = F.col("doc_id").cast("long")
    stamp = F.format_string(" *%02d:%02d*", k % 60, F.col("line_no"))
    lines = conversation_lines(spark, sf_dir).withColumn("text", F.when(k % 5 > 0, F.concat("text", stamp)).otherwise(F.col("text")))
    meta = LN.file_meta(lines).withColumn("work_id", F.floor(k / 4).cast("string"))
    files = PL.classified_files(meta)
    works = PL.classified(meta).select("work_id", F.col("duration_seconds").cast("long").alias("duration_seconds"), "files")
    return files.join(works, "work_id").select("work_id", "doc_id", "files", "duration_seconds", F.col("seconds").cast("long").alias("seconds"), "speaker_stage", "content_mode")


@query
def note_contract_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts of orders read as recordings: the price in seconds, the priority as the mode."""
    o = table(spark, sf_dir, "orders")
    seconds = (F.col("o_orderkey") * 37 % 11000).cast("long")
    mode = F.element_at(F.array(F.lit("monologue"), F.lit("conversation"), F.lit("workshop")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    chunks = (F.col("o_orderkey") % 12 + 1).cast("int")
    own = o.select("o_orderkey", seconds.alias("s"), mode.alias("m"), chunks.alias("c"))
    bounds, block, target = CT.tldr_bounds(F.col("m"), F.col("s"), F.col("c")), CT.block_contract(F.col("s"), F.col("m")), CT.density_targets(F.col("s"))
    own = own.withColumns({"bounds": bounds, "block": block, "target": target, "deep": CT.longform_targets(F.col("c"), block)})
    return own.select(
        "o_orderkey", F.col("bounds.min_items").cast("long").alias("tldr_min"), F.col("bounds.max_items").cast("long").alias("tldr_max"), F.col("block.theses_min").cast("long").alias("theses_min"), F.col("block.theses_max").cast("long").alias("theses_max"),
        F.col("block.meaning_section").alias("meaning_section"), F.col("block.detail_profile").alias("detail_profile"), F.col("target.min_words_per_min").cast("long").alias("words_per_min"), F.col("deep.min_meaning_blocks").cast("long").alias("min_meaning_blocks"), F.col("deep.min_case_blocks").cast("long").alias("min_case_blocks"),
        CT.format_label(F.col("m")).alias("format_label"), PL.execution_mode(F.col("c"), F.col("m"), F.col("s")).alias("execution_mode"),
    )


@query
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk counts of orders read as files: lines, stage, duration, tokens and mode from the key."""
    k = F.col("o_orderkey")
    stage = F.element_at(F.array(F.lit("required"), F.lit("optional"), F.lit("skip")), (k % 3 + 1).cast("int"))
    mode = F.element_at(F.array(F.lit("monologue"), F.lit("conversation"), F.lit("workshop")), (F.floor(k / 3) % 3 + 1).cast("int"))
    n, seconds, tokens = k * 7 % 15000, F.when(k % 2 == 0, k * 31 % 9000).otherwise(0), k * 13 % 40000
    own = table(spark, sf_dir, "orders").select(k, PL.chunk_count(n, stage, seconds, tokens, mode).cast("long").alias("chunks"), PL.min_blocks(n, tokens, seconds).cast("long").alias("min_blocks"), PL.target_lines(n, stage).cast("long").alias("target_lines"))
    return own


# Turns and speakers


@query
def conversation_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations landed as diarized JSON: each segment's role, and the speaker it becomes."""
    segment = F.struct(F.col("turn").cast("string").alias("start"), F.col("role").alias("speaker"), F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("transcript"))
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(segment)).alias("utterances"))).alias("content"))
    turns = RD.diarized_turns(c, fold=False)
    return turns.select(F.col("doc_id").alias("conv_id"), F.regexp_extract("text", "^(.+) ", 1).alias("role"), "speaker").distinct()


@query
def merged_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = LN.utterances(conversation_lines(spark, sf_dir), compat=True)
    return longs(LN.merge_turns(turns), "utt_no").select("doc_id", "utt_no", "speaker", "text")


@query
def merged_filled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = LN.utterances(conversation_lines(spark, sf_dir), compat=True).filter("text <> ''")
    return longs(LN.merge_filled_turns(turns), "utt_no").select("doc_id", "utt_no", "speaker", "text")


def speaker_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for speakers of conversations that have a system turn; other conversations have no mapping."""
    roles = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or(F.col("role") == "system").alias("_system"))
    two = F.explode(F.array(F.struct(F.lit("Speaker 1").alias("pattern"), F.lit("Иван $1").alias("replacement")), F.struct(F.lit("Speaker 12").alias("pattern"), F.lit("Speaker 1 bis").alias("replacement"))))
    return roles.filter("_system").select(F.col("conv_id").cast("string").alias("work_id"), two.alias("m")).select("work_id", "m.*")


def named_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations that name speakers with one digit and two; the longer pattern must come first."""
    return conversation_lines(spark, sf_dir).select(F.col("doc_id").alias("work_id"), "line_no", F.when(F.col("line_no") % 2 == 0, F.concat("text", F.lit(" (Speaker 12, Speaker 1)"))).otherwise(F.col("text")).alias("text"))


@query
def renamed_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = named_lines(spark, sf_dir)
    renamed = SP.rename_speakers(texts, speaker_maps(spark, sf_dir))
    return renamed.select("work_id", F.col("line_no").cast("long").alias("line_no"), "text", "modified")


@query
def rename_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = named_lines(spark, sf_dir)
    maps = speaker_maps(spark, sf_dir)
    return SP.rename_totals(SP.rename_speakers(texts, maps), maps)


@query
def transcript_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cues ten seconds apart, written as transcripts."""
    c = table(spark, sf_dir, "conversations")
    cues = c.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("cue_no"), (F.col("turn") * 10.0).alias("start_s"), F.regexp_replace("text", "\n", " ").alias("text"))
    return WR.cues_to_markdown(cues)


@query
def folded_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as words of a recording, grouped while the type stays."""
    e = table(spark, sf_dir, "events")
    words = e.select(F.col("user_id").cast("string").alias("doc_id"), F.col("event_id").alias("word_no"), F.lit("word").alias("type"), F.col("event_type").alias("speaker"), F.col("event_id").cast("string").alias("text"), (F.col("event_id") % 6000).cast("double").alias("start_s"))
    return longs(RD.words_to_turns(words), "utt_no").select("doc_id", "utt_no", "speaker", "text", "ts")


@query
def best_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as caption files of their source, their language in the name."""
    d = table(spark, sf_dir, "documents")
    files = d.select("doc_id", F.col("source").alias("work_id"), F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("lang"), F.lit(".vtt")).alias("name"), F.when(F.col("doc_id") % 2 == 0, 200).alias("seconds"))
    return RD.best_subtitles(doc_lines(spark, sf_dir), files)


@query
def numbered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("work_id"), X.chunk_label(F.col("event_id") % 60).alias("chunk_id"), F.col("event_id").alias("block_no"))
    return longs(WR.numbered_blocks(e), "number")


# Take-aways, topics, people


def doc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as its summaries, their lines as points; ids give the order of files."""
    lines = doc_lines(spark, sf_dir, "source").select(F.col("source").alias("work_id"), F.col("doc_id").alias("chunk_id"), "line_no", "text")
    return TL.summary_points(lines.filter("work_id is not null")).withColumn("file_no", F.col("chunk_id"))


@query
def summary_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(doc_points(spark, sf_dir).drop("file_no"), "pos")


@query
def tldr_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = doc_points(spark, sf_dir)
    targets = points.groupBy("work_id").agg(TL.target_count(F.count_distinct("file_no")).alias("target"))
    return longs(TL.merged_points(points, targets), "rank")


@query
def topic_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of documents as topics of their source."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    rows = d.select(F.col("source").alias("work_id"), F.regexp_extract("text", "^([^ \n]+)", 1).alias("topic"), F.lit("A").alias("chunk_id"), F.col("doc_id").alias("row_no"))
    none = rows.filter(F.lit(False)).select("work_id", "topic", F.col("row_no").alias("block_key"))
    top = AP.top_topics(AP.topic_counts(rows, none))
    return longs(top, "rank").select("work_id", "topic", "n", "rank")


@query
def topic_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item the document line that shares most tokens with it; items are few, and all lines are read."""
    topics = table(spark, sf_dir, "benchmark").select(F.lit("corpus").alias("work_id"), F.col("text").alias("topic"))
    lines = doc_lines(spark, sf_dir).select(F.lit("corpus").alias("work_id"), F.struct("doc_id", "line_no").alias("pos"), F.col("text").alias("line"))
    return longs(AP.best_lines(topics.distinct(), lines), "score")


@query
def people_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.people("text")).alias("name"))
    return d


@query
def imperative_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by the document's id, half of them going on with its first letters."""
    tail = F.when(F.col("doc_id") % 24 >= 12, F.concat(F.lit(" "), F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 40), "\n", " "))).otherwise("")
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(landed.pick(F.col("doc_id"), *ACTION_TEXTS), tail).alias("text"))
    return t.select("id", X.action_candidate("text").alias("candidate"), X.imperative("text").alias("imperative"), X.action_score(X.action_candidate("text")).cast("long").alias("score"), X.action_bucket(X.action_candidate("text")).alias("bucket"))


# Scalars


@query
def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7 % 20000).alias("s"))
    clock = F.concat_ws(":", (F.floor(F.col("s") / 60)).cast("string"), (F.col("s") % 60).cast("string"))
    return e.select("event_id", X.mmss("s").alias("mmss"), X.hhmmss("s").alias("hhmmss"), X.duration_seconds(clock).cast("long").alias("seconds"), X.vtt_seconds(clock).cast("long").alias("vtt_seconds"))


@query
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("event_id", landed.pick(F.col("event_id"), *TIMES).alias("text"))
    return t.select("event_id", "text", X.duration_seconds("text").cast("long").alias("seconds"), (X.vtt_seconds("text") * 1000).cast("long").alias("vtt_ms"))


@query
def video_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    tail = F.when(k % 20 >= 10, F.concat(F.lit("&p="), k.cast("string"))).otherwise("")
    t = table(spark, sf_dir, "pages").select(k, F.concat(landed.pick(k, *URLS), tail).alias("url"))
    return t.select("page_id", "url", X.video_id("url").alias("video_id"), PL.route(F.col("url")).alias("route"))


@query
def page_title_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.when(F.col("page_id") % 2 == 0, " &amp; &#233;&lt;").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", X.title_text(raw).alias("title")).withColumn("informative", X.is_title("title"))


@query
def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", PL.route(F.col("url")).alias("route"), X.source_reference(F.lit("youtube"), F.col("url"), F.lit(None).cast("string")).alias("reference"), X.note_id(F.lit(None).cast("string"), F.lit("local"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("url"), F.lit("b")).alias("note_id"))


@query
def person_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    t = table(spark, sf_dir, "documents").select(k, F.concat(landed.pick(k, *NAMES), F.when(k % 36 >= 18, F.concat(F.lit(" "), F.coalesce("lang", F.lit("?")), k.cast("string"))).otherwise("")).alias("name"))
    return t.select("doc_id", "name", X.person_text("name", unescaped=False).alias("person"), X.is_person("name").alias("is_person"), X.is_placeholder("name").alias("placeholder"), X.path_title("name", unescaped=False).alias("path_title"), F.array_join(X.split_values("name"), "|").alias("parts"))


@query
def topic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.size(X.topic_tokens("text")).cast("long").alias("n_tokens"), F.array_join(X.topic_tokens("text"), " ").alias("tokens"), X.limit_text("text").alias("short"), X.word_count("text").cast("long").alias("words"))


@query
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.short_hash("text").alias("short_hash"), F.sha1("text").alias("sha1"))


# Quality


@query
def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of a source's documents as case titles: those seen before."""
    first = doc_lines(spark, sf_dir, "source").filter("line_no = 1")
    lines = first.select(F.col("source").alias("work_id"), F.col("doc_id").alias("line_no"), F.concat(F.lit("### Кейс: "), "text").alias("text"))
    return QL.duplicate_case_titles(lines).select("work_id", F.explode("titles").alias("title"))


@query
def actionability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as checklists of their source; label 1 starts with a verb."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    text = F.concat(F.lit("- [ ] "), F.when(F.col("quality") == 1, "Проверь ").otherwise("страница "), F.col("doc_id").cast("string"))
    own = QL.actionability(d.select(F.col("source").alias("work_id"), F.col("doc_id").alias("line_no"), text.alias("text")))
    return own.select("work_id", "items", "verbish_items", F.floor(F.col("ratio") * 100 + 0.5).cast("long").alias("percent"), "ok")


@query
def note_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = doc_lines(spark, sf_dir, "source").groupBy("source").agg(F.sum(X.word_count("text")).alias("words"), F.count_distinct("doc_id").alias("blocks"))
    own = words.withColumn("d", QL.density(F.col("words"), F.col("blocks"), (F.col("blocks") * 100)))
    return own.select("source", "words", "blocks", F.floor(F.col("d.blocks_per_10min") * 100 + 0.5).cast("long").alias("per_10min_x100"), F.col("d.ok").alias("ok"))


@query
def header_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes with some header lines, by their id."""
    parts = [F.lit("# T"), F.lit("> a"), *[F.when(F.col("doc_id") % (k + 2) > 0, F.lit(f"**{x}:** y")) for k, x in enumerate(("Автор", "Формат", "Тема", "Длительность", "Источник"))], F.when(F.col("doc_id") % 7 > 0, F.lit("## Главная рамка автора")), F.when(F.col("doc_id") % 3 == 0, F.lit("Speaker 4 said unknown"))]
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array_compact(F.array(*parts))).alias("line_no", "text")).withColumnRenamed("doc_id", "work_id")
    own = QL.header_check(d).join(QL.placeholder_hits(d), "work_id")
    return own.select("work_id", "header_complete", F.array_join("missing_header_fields", ",").alias("missing"), F.array_join("placeholder_hits", ",").alias("hits"))


@query
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as blocks of 60 seconds, each fifth without an end."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("work_id"), F.col("event_id").alias("row_no"), F.unix_timestamp("ts").alias("start_s"))
    rows = e.withColumn("end_s", F.when(F.col("row_no") % 5 > 0, F.col("start_s") + 60))
    return QL.coverage_gaps(rows, most=300)


@query
def boundary_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("work_id"), (F.floor(F.col("event_id") / 3)).alias("chunk_id"), F.col("event_id").alias("block_no"), F.col("event_type").alias("topic"))
    return QL.boundary_duplicates(e)


@query
def shallow_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks, their lines numbered; those with fewer than six."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.regexp_replace("text", "(?m)^(?=.)", "1. ").alias("body"))
    return QL.shallow_blocks(d).select("doc_id", F.col("theses").cast("long").alias("theses"))


@query
def populated_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: every third line a section heading of one of two kinds."""
    n = F.col("line_no")
    text = F.when(n % 3 == 1, F.when(n % 2 == 0, F.lit("### Кейс: x")).otherwise(F.lit("### Смысл блока:"))).otherwise(F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.col("text")))
    lines = doc_lines(spark, sf_dir).select(F.col("doc_id").alias("work_id"), "line_no", text.alias("text"))
    return QL.populated_sections(lines)


# State


@query
def event_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    return ST.latest_state(e, "user_id", ("ts_us", "event_id"))


@query
def event_change_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as runs of a note."""
    e = table(spark, sf_dir, "events")
    runs = e.select(F.col("user_id").alias("note_id"), F.col("event_id").alias("run_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("finished_at"), F.col("event_type").alias("transcript"), (F.col("event_id") % 3).cast("string").alias("markdown"), (F.col("event_id") % 2).cast("string").alias("html"), F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("quality"), F.lit("").alias("delivery"))
    flags = ST.change_flags(runs)
    return flags.select("note_id", "run_id", "first_run", "input_changed", "output_changed", "quality_changed", "delivery_changed", "only_resume")


@query
def event_stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("work_id"), F.lit(True).alias("planned"), F.element_at(F.array(F.lit("ready"), F.lit("partial"), F.lit("missing"), F.lit("stale")), F.when(F.col("event_id") % 11 == 0, 4).when(F.col("user_id") % 3 == 0, 1).otherwise(F.col("event_id") % 3 + 1).cast("int")).alias("status"))
    return ST.extraction_rollup(e)


@query
def planned_vs_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are planned; labels, moved to twice their id, observed."""
    plan = table(spark, sf_dir, "documents").select(F.lit("corpus").alias("work_id"), F.col("doc_id").alias("chunk_id"))
    seen = table(spark, sf_dir, "labels").select(F.lit("corpus").alias("work_id"), (F.col("doc_id") * 2).alias("chunk_id"), F.col("quality").cast("long").alias("blocks"), (F.col("toxic") == 1).alias("manifest"))
    own = ST.planned_and_observed(plan, seen)
    none = plan.filter("false")
    statuses = ST.chunk_statuses(plan.withColumns({"chunk_fingerprint": F.lit(""), "expected_outputs": F.array().cast("array<string>")}), seen, none.withColumns({"fingerprint": F.lit(""), "outputs": F.array().cast("array<string>")}), none.select("work_id", F.lit("").alias("name")))
    return own.select("work_id", "chunk_id", "planned", "observed").join(statuses.select("work_id", "chunk_id", "status"), ["work_id", "chunk_id"])


@query
def pending_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, done = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id")
    return ST.pending(d, done, ("doc_id",))


@query
def next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a work, its stages by its key."""
    k = F.col("c_custkey")

    def pick(n: int, *values: str) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(k / n) % len(values) + 1).cast("int"))

    works = table(spark, sf_dir, "customer").select(k, pick(1, "ready", "partial", "missing", "stale").alias("extraction"), pick(4, "skip", "required", "optional").alias("speaker_hint"), (k % 2 == 0).alias("has_speakers"), (k % 5 > 1).alias("has_tldr"), (k % 7 > 2).alias("has_html"), F.lit("f").alias("fingerprint"), pick(3, "f", "g", "").alias("tldr_fingerprint"), pick(2, "f", "").alias("assemble_fingerprint"), F.lit(None).cast("string").alias("stored_speaker"), pick(5, "missing", "ready").alias("stored_tldr"), F.lit("").alias("stored_assemble"))
    s = ST.stage_statuses(works)
    return s.select("c_custkey", "speaker", "tldr", "assemble", ST.next_action(F.col("speaker_hint"), F.col("speaker"), F.col("extraction"), F.col("tldr"), F.col("assemble")).alias("next_action"))


@query
def stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("ts", F.concat(F.lit("stage."), "event_type").alias("event"), (F.col("event_id") % 1000).alias("duration_ms"))
    return TR.stage_metrics(e)


@query
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events start a run, the odd one after them ends it, but for every tenth."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 2 == 0, "run.started").when(F.col("event_id") % 20 == 1, "run.note").otherwise("run.finished")
    own = e.select("ts", kind.alias("event"), F.floor(F.col("event_id") / 2).cast("string").alias("run_id"), F.col("user_id").cast("string").alias("note_id"), F.lit('{"status": "assembled"}').alias("props"))
    return TR.run_ledger(own).select("run_id", "note_id", "status")


@query
def batch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("file"), F.when(F.col("o_orderkey") % 9 > 0, "ok").otherwise("error").alias("status"))
    listed = o.withColumns({"title": F.when(F.col("file").endswith("7"), None).otherwise(F.concat(F.lit("A&B <"), "file", F.lit('>'))), "html": F.when(F.col("file").endswith("3"), None).otherwise(F.concat("file", F.lit(".html")))})
    return WR.batch_index(listed).withColumn("html", F.sha2("html", 256))


@query
def already_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    notes = d.select("doc_id", F.col("source").alias("title"), F.col("doc_id").cast("string").alias("path"), F.lit("c").alias("chat"), F.sha2("text", 256).alias("sha256"))
    sent = d.select(F.col("source").alias("title"), F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 4 == 0, "c").otherwise("other").alias("chat"), F.when(F.col("doc_id") % 3 > 0, F.sha2("text", 256)).when(F.col("doc_id") % 5 == 0, "x").alias("sha256"), (F.col("doc_id") % 2 == 0).alias("success"))
    return ST.already_delivered(notes, sent).select("doc_id", "path")


QUERIES |= landed.QUERIES | notes.QUERIES | files.QUERIES | streams.QUERIES
