"""Queries over notes and the state of their works: quality and contracts, appendix, statuses, plans, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.functions import text as X
from colloquy.operators import appendix as AP
from colloquy.operators import contract as CT
from colloquy.operators import ingest as IN
from colloquy.operators import lines as LN
from colloquy.operators import plan as PL
from colloquy.operators import quality as QL
from colloquy.operators import state as ST
from colloquy.plans.fixtures import ACTION_TEXTS
from colloquy.plans.landed import pick
from colloquy.plans.views import doc_lines, table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def when(test: Column, text: Column | str) -> Column:
    return F.when(test, text if isinstance(text, Column) else F.lit(text))


# Notes


def note_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: which lines a note has depends on its id, and one of them is the document's text."""
    k = F.col("doc_id")
    labels = [when(k % (i + 2) > 0, f"**{x}:** y") for i, x in enumerate(L.HEADER_LABELS)]
    parts = [
        when(k % 11 > 0, "# T"), when(k % 13 > 0, "> abstract"), *labels, when(k % 7 > 0, f"## {L.AUTHOR_FRAME}"), when(k % 9 == 0, "Speaker 4 said unknown"), when(k % 10 == 0, "- **—** x"),
        F.concat(F.lit("### Кейс: Title "), (k % 3).cast("string")), when(k % 4 > 0, "case text"), F.concat(F.lit("### Кейс:  title "), (k % 2).cast("string")), F.lit("more"),
        F.lit("### Смысл блока:"), when(k % 3 > 0, "means"), F.lit("### Действия"), F.lit("- [ ] Проверь всё"), when(k % 2 == 0, "- [x] страница"), when(k % 5 == 0, "- [ ] Не бойся"),
        F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "), when(k % 3 == 0, "> quote"),
    ]
    return table(spark, sf_dir, "documents").select(k.alias("work_id"), F.posexplode(F.array_compact(F.array(*parts))).alias("line_no", "text"))


def note_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as works with their contract."""
    k = F.col("doc_id")
    own = table(spark, sf_dir, "documents").select(
        k.alias("work_id"), pick(k, "monologue", "conversation", "workshop").alias("content_mode"), pick(F.floor(k / 2), "single", "micro-multi", "multi").alias("execution_mode"), (k * 37 % 11000).alias("duration_seconds"),
        (k % 12 + 1).cast("int").alias("total_chunks"), pick(k, "@Ann Lee", "creator", None).alias("author_hint"), (k % 25).alias("block_count"), (k % 15).alias("tldr_count"),
    )
    return CT.note_contract(own)


@query
def note_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("contract")
    return note_works(spark, sf_dir).select(
        "work_id", F.array_join(c["header"]["required_metadata"], ",").alias("required"), F.array_join(c["header"]["optional_metadata"], ",").alias("optional"), c["header"]["format_label"].alias("format"), c["tldr"]["strategy"].alias("strategy"),
        c["tldr"]["min_items"].cast("long").alias("tldr_min"), c["tldr"]["max_items"].cast("long").alias("tldr_max"), c["blocks"]["case_section"].alias("case_section"), F.size(c["required_sections"]).cast("long").alias("sections"),
    )


@query
def note_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of every note: measures, errors, exit code, status and whether it is delivered."""
    k = F.col("work_id")
    q = QL.contract_errors(QL.final_quality(note_lines(spark, sf_dir), note_works(spark, sf_dir)))
    errors = F.col("contract_errors")
    shell = F.when(k % 17 == 0, 3).otherwise(0)
    return q.select(
        k, F.col("word_count").cast("long").alias("word_count"), "header_complete", F.array_join("missing_header_fields", ",").alias("missing"), F.array_join("placeholder_hits", ",").alias("hits"), F.array_join("duplicate_case_titles", ",").alias("duplicates"),
        F.col("meaning_blocks").cast("long").alias("meaning_blocks"), F.col("case_blocks").cast("long").alias("case_blocks"), "tldr_length_ok", F.col("actionability.ok").alias("actions_ok"), F.col("density.ok").alias("density_ok"), F.col("longform.ok").alias("longform_ok"),
        F.array_join(errors, "; ").alias("errors"), QL.assemble_outcome(errors, shell).cast("long").alias("code"), QL.run_status(errors, shell).alias("status"), QL.delivery_reason(errors, k % 8 == 0, when(k % 3 > 0, "c"), k % 5 == 0).alias("reason"),
    )


@query
def quality_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = QL.quality_summary(QL.contract_errors(QL.final_quality(note_lines(spark, sf_dir), note_works(spark, sf_dir))))
    return longs(q.withColumn("contract_errors", F.size("contract_errors").cast("long")), "tldr_count")


@query
def quotes_and_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QL.quote_and_case_totals(note_lines(spark, sf_dir))


@query
def prepare_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    works = table(spark, sf_dir, "orders").select(
        k, (k * 37 % 11000).alias("duration_seconds"), (k % 12 + 1).cast("int").alias("total_chunks"), pick(k, "monologue", "conversation", "workshop").alias("content_mode"), pick(F.floor(k / 3), "single", "micro-multi", "multi").alias("execution_mode"),
        pick(F.floor(k / 2), "skip", "optional", "required", "odd").alias("speaker_stage"), pick(F.floor(k / 5), "youtube", "local", None).alias("source_kind"), pick(k, "Ann Lee", "12:30").alias("author_hint"),
    )
    q = CT.prepare_quality(works)
    return q.select("o_orderkey", "routing_ok", "fast_path_expected", "fast_path_ok", "fragmentation_ok", F.floor(F.col("blocks_per_10min") * 100 + 0.5).cast("long").alias("per_10min_x100"))


@query
def header_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    works = table(spark, sf_dir, "documents").select(k.alias("work_id"), when(k % 4 > 0, "x").alias("_t"), pick(k, "skip", "required").alias("speaker_stage"), pick(k, " Ann ", None, " ").alias("author_hint"))
    works = works.withColumn("title_candidates", F.array_compact(F.array("_t", F.concat(F.lit("T"), F.col("work_id").cast("string"))))).drop("_t")
    return PL.header_seed(works).select("work_id", "topic_hint", "participants_hint", "author_hint")


@query
def title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("doc_id"), table(spark, sf_dir, "documents")
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    chapters = F.array(first, F.lit("# Chapter one"), F.lit("12:30"), F.lit("never taken"))
    hints = F.array(F.lit("chapter ONE"), F.concat(F.lit("**Hint** "), (k % 5).cast("string")), F.lit("lecture"), first, F.lit("> Last one"), F.lit("abc"), F.lit("Final words"))
    return d.select("doc_id", F.array_join(LN.title_candidates(pick(k, "@Ann Lee", "creator", None), chapters, hints), "|").alias("titles"))


@query
def local_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of documents as local files: from a heading, a line, the stem or the folder."""
    k, d = F.col("doc_id"), table(spark, sf_dir, "documents")
    files = d.select("doc_id", pick(k, "transcript", "deep_learning-intro", "12:30").alias("stem"), pick(F.floor(k / 2), "good_folder", "notes").alias("parent"))
    text = F.concat(pick(k, "00:10", "", "lecture"), F.lit("\n"), F.when(k % 4 == 0, F.lit("# Heading here")).when(k % 4 == 1, F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)\n.*", "")).otherwise(F.lit("*12:30*")))
    from colloquy.sources.readers import lines_of

    return LN.local_title(files, lines_of(d.select("doc_id", text.alias("text"))))


# Scalars


@query
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("doc_id"), table(spark, sf_dir, "documents")
    first = F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "), 1, 60)
    return d.select(
        "doc_id", X.statement(F.concat(pick(k, "**Lead:** ", "— ", ""), first, pick(F.floor(k / 2), "...", " *(12:30)*", ""))).alias("statement"), X.slug(first).alias("slug"),
        F.sha2(X.collapse_blank_lines(F.concat(F.lit(" \n"), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n\n\n\n"), F.lit("\n"))), 256).alias("collapsed"), X.delivery_name(F.concat(first, pick(k, " <a>?", "\r\nb.", " . ")), ".html").alias("file_name"),
        X.language_code(pick(k, "Russian", "English (auto)", "ru-RU", "Deutsch", "")).alias("language"), X.language_hint(pick(k, " DE ", "auto", "")).alias("hint"), F.array_join(X.external_refs(first, pick(k, "a,b\n a", None)), "|").alias("refs"),
        X.caption(first, pick(k, "youtube", "local", "other"), pick(F.floor(k / 2), " https://a.b ", ""), F.lit(" f.mp3 ")).alias("caption"), F.array_join(X.first_distinct(F.split(first, " ")), " ").alias("distinct_words"),
    )


@query
def note_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    values = [pick(k, None, None, None, "own"), pick(k, "youtube", "telegram", "local"), pick(F.floor(k / 2), "vid", None), pick(k, "chat", ""), pick(k, "7", None, "8"), pick(F.floor(k / 3), "/p", None, " "), pick(F.floor(k / 4), "https://u", ""), k.cast("string")]
    return table(spark, sf_dir, "documents").select("doc_id", X.note_id(*values).alias("note_id"))


@query
def caption_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array(F.lit(" <c.x>A &amp; B"), F.lit(""), F.regexp_replace(F.coalesce("text", F.lit("")), "&", "and"), F.lit("it&#39;s</c>  "))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.clean_caption(lines), 256).alias("sha256"))


@query
def merged_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    base = F.concat(F.lit('{"a": '), k, F.lit(', "b": {"x": 1, "y": [1, 2]}, "c": {"z": 1}}'))
    patch = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"b": {"y": [3], "w": '), k, F.lit('}, "d": "n"}'))).when(F.col("doc_id") % 3 == 1, '{"c": 5}').otherwise("{}")
    one = table(spark, sf_dir, "documents").select("doc_id", X.merge_json(base, patch).alias("m"), X.merge_maps(F.create_map(F.lit("a"), k, F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), when(F.col("doc_id") % 2 == 0, "2"), F.lit("c"), k)).alias("s"))
    paths = {"a": "$.a", "x": "$.b.x", "y": "$.b.y", "w": "$.b.w", "c": "$.c", "d": "$.d"}
    return one.select("doc_id", *[F.get_json_object("m", p).alias(n) for n, p in paths.items()], F.col("s")["a"].alias("map_a"), F.col("s")["b"].alias("map_b"), F.col("s")["c"].alias("map_c"))


# Appendix


def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks of their source's note."""
    k, n = F.col("doc_id"), F.col("doc_id").cast("string")
    parts = [
        F.when(k % 3 == 0, F.concat(F.lit("# Блок 1: Topic  "), (k % 20).cast("string"))).when(k % 3 == 1, F.concat(F.lit("## Topic "), (k % 20).cast("string"), F.lit(" (00:10–00:20)"))), F.lit("0. too early"), F.lit("### Тезисы:"),
        F.concat(F.lit("1. **Lead** Thesis "), n, F.lit(". ")), F.concat(F.lit("2. "), pick(k, *ACTION_TEXTS)), F.lit("- plain bullet"), F.concat(F.lit("- *(01:00)* Bullet "), n), F.lit("### Кейс: x"), F.lit("3. too late"), when(k % 2 == 0, "**Вывод:** The end."),
    ]
    return table(spark, sf_dir, "documents").select(F.col("source").alias("work_id"), k.alias("block_key"), F.posexplode(F.array_compact(F.array(*parts))).alias("line_no", "text"))


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as manifest rows of their source."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("work_id"), X.chunk_label(k % 60).alias("chunk_id"), k.alias("row_no"), F.concat(F.lit("b"), k.cast("string")).alias("block_file"), F.when(k % 5 > 0, F.concat(F.lit("Topic "), (k % 20).cast("string"))).alias("topic"),
        pick(k, None, "— Claim one.", None, "Claim two").alias("primary_claim"), pick(F.floor(k / 2), None, " A  case ", "").alias("case_title"), pick(k, "Ann Lee; Speaker 2", "—", None, "Bob Ray|Ann Lee").alias("names"),
        *[pick(F.floor(k / m), *ACTION_TEXTS[a:b], None, None).alias(c) for c, m, a, b in (("action_now", 1, 0, 4), ("action_check", 2, 4, 8), ("action_avoid", 3, 8, 12))],
    )


@query
def block_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(AP.block_candidates(block_lines(spark, sf_dir)), "line_no")


@query
def block_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AP.block_topics(block_lines(spark, sf_dir))


@query
def note_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent topics of manifests and block headings."""
    counts = AP.topic_counts(manifest_rows(spark, sf_dir), AP.block_topics(block_lines(spark, sf_dir)))
    return longs(AP.top_topics(counts), "rank").select("work_id", "topic", "n", "rank")


@query
def topic_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AP.topic_descriptions(manifest_rows(spark, sf_dir), AP.block_candidates(block_lines(spark, sf_dir)))


@query
def described_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as topics: some described, others by the document line that shares most tokens, or by neither."""
    b, k = table(spark, sf_dir, "benchmark"), F.col("item_id")
    work = F.lit("corpus").alias("work_id")
    top = b.select(work, F.when(k % 5 == 4, F.concat(F.lit("no "), k.cast("string"))).otherwise(F.col("text")).alias("topic"), F.lit(1).cast("long").alias("n"), k.alias("rank"))
    told = top.filter("rank % 2 = 0").select("work_id", "topic", F.concat(F.lit("Told "), F.repeat(F.lit("word "), F.col("rank").cast("int"))).alias("description"))
    lines = doc_lines(spark, sf_dir).select(work, F.struct("doc_id", "line_no").alias("pos"), F.col("text").alias("line"))
    return AP.described_topics(top, told, lines).select("topic", "rank", "description")


@query
def entity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in manifest rows with their contexts."""
    return AP.entity_lines(AP.entity_contexts(manifest_rows(spark, sf_dir), "names"))


@query
def people_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of manifests and seeds with their first two contexts."""
    m = manifest_rows(spark, sf_dir)
    none = m.filter("false").select("work_id", F.lit("").alias("statement"), F.lit("").alias("topic"), F.lit(0).alias("block_key"))
    seeds = m.select("work_id").distinct().select("work_id", F.when(F.col("work_id").endswith("1"), "Cid  Fox").alias("author_hint"), F.array(F.lit("Cid Fox"), F.lit(" Dan  Elk"), F.lit("unknown")).alias("speaker_candidates"))
    return AP.entity_lines(AP.people_contexts(m, none, seeds))


@query
def note_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actions that a note lists, from manifests, blocks and, where these give few, summaries: the documents' first lines."""
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("work_id"), F.col("doc_id").alias("pos"), F.concat(F.lit("запиши вопрос "), F.substring_index(first, " ", 3), F.lit(" сегодня")).alias("line"))
    found = AP.action_rows(manifest_rows(spark, sf_dir), AP.block_candidates(block_lines(spark, sf_dir)), lines)
    return longs(AP.top_actions(found), "rank").select("work_id", "bucket", "rank", "action")


@query
def appendices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appendices of documents as works: which parts there are depends on the id."""
    k, d = F.col("doc_id"), table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("work_id"))
    people = d.filter("doc_id % 2 = 0").select("work_id", F.explode(F.array(F.lit("Bob"), F.lit("Ann"))).alias("name")).withColumn("contexts", F.concat(F.lit("in "), F.col("work_id").cast("string")))
    resources = d.filter("doc_id % 3 = 0").select("work_id", F.lit("Miro").alias("name"), F.lit("board").alias("contexts"))
    actions = d.select("work_id", F.explode(F.array_compact(F.array(when(k % 2 == 1, "immediate"), when(k % 5 == 0, "month"), when(k % 7 == 0, "ongoing")))).alias("bucket")).withColumn("rank", F.explode(F.array(F.lit(2), F.lit(1))))
    actions = actions.withColumn("action", F.concat_ws(" ", F.lit("do"), "bucket", F.col("rank").cast("string")))
    topics = d.filter("doc_id % 4 > 0").select("work_id", F.explode(F.array(F.lit(2), F.lit(1))).alias("rank")).select("work_id", "rank", F.concat(F.lit("Topic "), F.col("rank").cast("string")).alias("topic"), F.lit("told").alias("description"))
    return AP.appendix_text(d, people, resources, actions, topics)


# State


def artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the chunks of sources: which there are depends on the document's id."""
    k, c = F.col("doc_id"), X.chunk_label(F.col("doc_id"))
    names = [when(k % 2 == 0, F.concat(F.lit("chunk_"), c, F.lit("_block_01.md"))), when(k % 3 > 0, F.concat(F.lit("manifest_chunk_"), c, F.lit(".tsv"))), when(k % 5 > 0, F.concat(F.lit("summary_chunk_"), c, F.lit(".md"))), when(k % 97 == 0, "tldr.md"), when(k % 89 == 0, "x.html"), when(k % 83 == 0, "speakers.txt"), when(k % 79 == 0, "header.md"), when(k % 71 == 0, "appendix.md")]
    return table(spark, sf_dir, "documents").select(F.col("source").alias("work_id"), F.explode(F.array_compact(F.array(*names))).alias("name"))


@query
def artifact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.artifact_counts(artifact_files(spark, sf_dir))


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk statuses of sources: two of three documents planned, three of four with a sentinel."""
    k, c, d = F.col("doc_id"), X.chunk_label(F.col("doc_id")), table(spark, sf_dir, "documents")
    outputs = F.array(F.concat(F.lit("manifest_chunk_"), c, F.lit(".tsv")), F.concat(F.lit("summary_chunk_"), c, F.lit(".md")))
    plan = d.filter("doc_id % 7 <> 6").select(F.col("source").alias("work_id"), c.alias("chunk_id"), pick(k, "f", "g", "").alias("chunk_fingerprint"), outputs.alias("expected_outputs"))
    sentinels = d.filter("doc_id % 4 > 0").select(F.col("source").alias("work_id"), c.alias("chunk_id"), pick(F.floor(k / 2), "f", "g", "f").alias("fingerprint"), F.when(k % 8 == 1, F.slice(outputs, 1, 1)).otherwise(F.array().cast("array<string>")).alias("outputs"))
    files = artifact_files(spark, sf_dir)
    return ST.chunk_statuses(plan, ST.observed_chunks(files), sentinels, files)


@query
def chunk_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statuses(spark, sf_dir)


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as works with the status of their stages."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("work_id"), pick(k, "ready", "partial", "missing", "stale").alias("extraction"), pick(F.floor(k / 4), "skip", "required", "optional", None).alias("speaker_hint"), pick(F.floor(k / 2), "ready", "missing", "skipped").alias("speaker"), pick(F.floor(k / 3), "ready", "stale").alias("tldr"), pick(F.floor(k / 5), "ready", "missing").alias("assemble"),
        (k % 12 + 1).cast("int").alias("total_chunks"), pick(k, "monologue", "conversation").alias("content_mode"), pick(F.floor(k / 7), "", "multi", None).alias("execution_mode"), pick(k, None, None, "x").isNotNull().alias("reused"),
    )


def work_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks of their customer."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("work_id"), X.chunk_label(k % 100).alias("chunk_id"), (k % 5 > 0).alias("planned"), pick(F.floor(k / 2), "missing", "ready", "missing", "partial", "stale").alias("status"))


PLAN_COLUMNS = ("work_id", "mode", "next_action", "resume", "run_speaker", "run_extraction", "run_tldr", "tldr_strategy", "rename_speakers", "run_assemble")


@query
def execution_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ST.execution_plan(stages(spark, sf_dir), work_statuses(spark, sf_dir))
    return p.select(*PLAN_COLUMNS, *[F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("pending_chunk_ids", "ready_chunk_ids", "partial_chunk_ids", "blocked_by")])


@query
def status_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("work_id"), pick(F.col("o_orderkey"), "chunk_A_block_1.md", "x.html", "tldr.md", "summary_chunk_A.md").alias("name"))
    p = ST.status_payload(stages(spark, sf_dir), work_statuses(spark, sf_dir), files)
    return p.select("work_id", "next_action", "planned_chunks", "ready_chunks", "partial_chunks", "missing_chunks", "stale_chunks", "blocks", "summaries", "html", "has_header")


@query
def loaded_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("c_custkey"), table(spark, sf_dir, "customer")
    states = c.filter(k % 3 == 0).select(k.alias("work_id"), when(k % 2 == 0, "state").alias("mode"), k.alias("chunks"))
    plans = c.filter(k % 4 > 0).select(k.alias("work_id"), F.lit("plan").alias("mode"), F.lit("p").alias("stage"))
    reports = c.filter(k % 5 > 0).select(k.alias("work_id"), F.lit("report").alias("mode"), F.lit("r").alias("stage"), (k * 2).alias("chunks"))
    return ST.loaded_state(c.select(k.alias("work_id")), states, plans, reports)


@query
def normalised_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    items = table(spark, sf_dir, "documents").select(k.alias("n"), pick(k, " A ", "", None).alias("chunk_id"), pick(F.floor(k / 3), "7", None, "  ").alias("id"))
    return ST.normalised_plan(items).select("n", "chunk_id")


@query
def newer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works whose events came after they were made."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("work_id"), (F.col("event_id") * 7 % 1000).alias("modified"))
    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("work_id"), F.when(F.col("c_custkey") % 9 > 0, 990 + F.col("c_custkey") % 10).alias("modified")).filter("work_id % 3 > 0")
    return ST.newer_sources(made, e)


@query
def reusable_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    current = d.select("doc_id", X.short_hash(F.coalesce("text", F.lit(""))).alias("fingerprint"))
    return ST.reusable(current, d.filter("doc_id % 3 = 0").select(X.short_hash(F.coalesce("text", F.lit(""))).alias("fingerprint")))


@query
def run_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    runs = e.select(F.col("user_id").alias("note_id"), k.alias("run_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("finished_at"), F.lit("assemble").alias("command"), pick(k, "assembled", "failed").alias("status"), F.col("event_type").alias("title"), pick(F.floor(k / 3), "t1", "t2").alias("transcript"), F.lit("m").alias("markdown"), pick(k, "h", "").alias("html"), F.lit(None).cast("string").alias("quality"), pick(F.floor(k / 2), None, "d").alias("delivery"))
    t = ST.timeline(runs)
    return t.select("run_id", "note_id", "status", "title", F.col("hashes.transcript").alias("transcript"), F.col("change_flags.first_run").alias("first_run"), F.col("change_flags.input_changed").alias("input_changed"), F.col("change_flags.output_changed").alias("output_changed"), F.col("change_flags.delivery_changed").alias("delivery_changed"), F.col("change_flags.only_resume").alias("only_resume"))


@query
def delivery_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(k.alias("work_id"), (k % 2 == 0).alias("enabled"), when(k % 3 == 0, "r").alias("reason"), when(k % 5 > 0, "c").alias("chat"))
    own = ST.delivery_summary(d)
    return own.select("work_id", F.size("delivery").cast("long").alias("fields"), F.col("delivery")["enabled"].alias("enabled"), F.col("delivery")["reason"].alias("reason"))


# Transcription


@query
def transcribe_backends(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", IN.transcribe_backend(pick(k, " Auto", "Groq ", "whisperx", "auto"), k % 3 == 0, k % 2 == 0, k % 5 > 1).alias("backend"))


@query
def retried_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as requests of up to six tries."""
    k, n = F.col("event_id"), F.col("event_id") % 6
    e = table(spark, sf_dir, "events").select(F.floor(k / 6).alias("request_id"), n.cast("int").alias("attempt"), (F.col("user_id") % 7 == 3).alias("ok"), (F.col("user_id") % 3 == 0).alias("limited"), pick(F.col("user_id"), "try again in 1m12s", "in 3m0s", "busy", None).alias("message"))
    return IN.retried(e)


@query
def host_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    tools = F.create_map(F.lit("ffmpeg"), k % 2 == 0, F.lit("curl"), k % 3 > 0, F.lit("pandoc"), k % 5 == 0)
    hosts = table(spark, sf_dir, "customer").select(k.alias("host"), pick(k, "darwin", "linux").alias("platform"), tools.alias("tools"), (k % 7 == 0).alias("has_key"), (k % 4 == 0).alias("parakeet"), (k % 6 == 0).alias("whisper"))
    return IN.doctor(hosts).withColumn("missing_tools", F.array_join("missing_tools", ","))
