"""Workflow state: chunk and stage statuses, what to do next, changes between runs, deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators.plan import execution_mode, tldr_strategy


def observed_chunks(files: DataFrame) -> DataFrame:
    """work_id, chunk_id, blocks and manifest, from file names (work_id, name)."""
    block, manifest = F.regexp_extract("name", r"^chunk_([A-Za-z0-9]+)_block_\d+\.md$", 1), F.regexp_extract("name", r"^manifest_chunk_([A-Za-z0-9]+)\.tsv$", 1)
    own = files.withColumns({"chunk_id": X.first_filled(block, manifest), "_b": block != "", "_m": manifest != ""}).filter("chunk_id <> ''")
    return own.groupBy("work_id", "chunk_id").agg(F.count_if("_b").alias("blocks"), F.bool_or("_m").alias("manifest"))


def planned_and_observed(plan: DataFrame, observed: DataFrame) -> DataFrame:
    """The full outer join of planned and observed chunks, with which side each is on."""
    p = plan.withColumn("planned", F.lit(True))
    o = observed.withColumn("observed", F.lit(True))
    return p.join(o, ["work_id", "chunk_id"], "full_outer").fillna(False, ["planned", "observed"])


def chunk_statuses(plan: DataFrame, observed: DataFrame, sentinels: DataFrame, files: DataFrame) -> DataFrame:
    """work_id, chunk_id, status: ready, partial, missing or stale.

    plan: work_id, chunk_id, chunk_fingerprint, expected_outputs. sentinels: work_id, chunk_id, fingerprint, outputs.
    files: work_id, name of what exists.
    """
    own = planned_and_observed(plan, observed).join(sentinels.select("work_id", "chunk_id", F.col("fingerprint").alias("_told"), F.col("outputs").alias("_outputs"), F.lit(True).alias("_sentinel")), ["work_id", "chunk_id"], "left")
    own = own.withColumn("_expected", F.when(F.coalesce(F.size("_outputs"), F.lit(0)) > 0, F.col("_outputs")).otherwise(F.col("expected_outputs")))
    needed = own.select("work_id", "chunk_id", F.explode("_expected").alias("name"))
    there = needed.join(files.select("work_id", "name").distinct().withColumn("_there", F.lit(True)), ["work_id", "name"], "left")
    counts = there.groupBy("work_id", "chunk_id").agg(F.count("*").alias("_need"), F.count("_there").alias("_have"))
    own = own.join(counts, ["work_id", "chunk_id"], "left").fillna(0, ["_need", "_have", "blocks"]).fillna(False, ["manifest"])
    some = (F.col("blocks") > 0) | F.col("manifest")
    differs = (F.coalesce("chunk_fingerprint", F.lit("")) != "") & (F.coalesce("_told", F.lit("")) != "") & (F.col("chunk_fingerprint") != F.col("_told"))
    with_sentinel = F.when(differs, "stale").when((F.col("_need") > 0) & (F.col("_have") == F.col("_need")) & some, "ready").when((F.col("_have") > 0) | some, "partial").otherwise("missing")
    without = F.when((F.col("blocks") > 0) & F.col("manifest"), "ready").when(some, "partial").otherwise("missing")
    status = F.when(~F.col("planned"), F.when(some, "stale").otherwise("missing")).when(F.col("_sentinel"), with_sentinel).otherwise(without)
    return own.select("work_id", "chunk_id", "planned", status.alias("status"))


def extraction_rollup(statuses: DataFrame, by: str = "work_id") -> DataFrame:
    """The status of each work's extraction, and planned chunks by status."""
    own = statuses.filter("planned")
    every, anyone = F.bool_and(F.col("status") == "ready"), lambda s: F.bool_or(F.col("status") == s)
    overall = F.when(every, "ready").when(anyone("stale"), "stale").when(anyone("ready") | anyone("partial"), "partial").otherwise("missing")
    return own.groupBy(by).agg(overall.alias("extraction"), F.count("*").alias("planned_chunks"), *[F.count_if(F.col("status") == s).alias(f"{s}_chunks") for s in ("ready", "partial", "missing", "stale")])


def stage_statuses(works: DataFrame) -> DataFrame:
    """works with the status of their four stages; what is observed beats what is stored, and staleness goes down the chain.

    works: extraction, speaker_hint, has_speakers, has_tldr, has_html, fingerprint, tldr_fingerprint, assemble_fingerprint,
    stored_speaker, stored_tldr, stored_assemble (null where unknown).
    """

    def differs(c: str) -> Column:
        return F.coalesce((F.col(c) != "") & (F.col("fingerprint") != "") & (F.col(c) != F.col("fingerprint")), F.lit(False))

    def stored(c: str) -> Column:
        return X.first_filled(X.strip(F.coalesce(F.col(c), F.lit(""))), F.lit("missing"))

    unready = F.coalesce(F.col("extraction") != "ready", F.lit(True))
    speaker = F.when(F.col("speaker_hint") == "skip", "skipped").when(F.col("has_speakers"), "ready").otherwise(stored("stored_speaker"))
    tldr = F.when(F.col("has_tldr"), F.when(unready | differs("tldr_fingerprint"), "stale").otherwise("ready")).otherwise(stored("stored_tldr"))
    own = works.withColumns({"speaker": speaker, "tldr": tldr})
    broken = unready | (F.col("has_tldr") & (F.col("tldr") != "ready")) | differs("assemble_fingerprint")
    return own.withColumn("assemble", F.when(F.col("has_html"), F.when(broken, "stale").otherwise("ready")).otherwise(stored("stored_assemble")))


def next_action(hint: Column, speaker: Column, extraction: Column, tldr: Column, assemble: Column) -> Column:
    out = F.when((hint == "required") & ~speaker.isin("ready", "skipped"), "speaker-identification").when(extraction != "ready", "extract-chunks")
    return out.when(tldr != "ready", "generate-tldr").when(assemble != "ready", "assemble").otherwise("done")


def execution_plan(stages: DataFrame, statuses: DataFrame) -> DataFrame:
    """A row per work: mode, next action, what should run, what blocks assembly, and chunks by state.

    stages: as stage_statuses gives, with total_chunks, content_mode, execution_mode and reused.
    """
    chunks = statuses.filter("planned")

    def ids(test: Column) -> Column:
        found = F.array_sort(F.collect_list(F.when(test, F.struct(F.length("chunk_id").alias("n"), "chunk_id"))))
        return F.transform(found, lambda s: s["chunk_id"])

    status = F.col("status")
    lists = chunks.groupBy("work_id").agg(ids(status != "ready").alias("pending_chunk_ids"), ids(status == "ready").alias("ready_chunk_ids"), ids(status == "partial").alias("partial_chunk_ids"))
    begun = statuses.groupBy("work_id").agg(F.bool_or(status.isin("ready", "partial")).alias("_begun"))
    own = stages.join(lists, "work_id", "left").join(begun, "work_id", "left")
    mode = X.first_filled(F.coalesce("execution_mode", F.lit("")), execution_mode(F.col("total_chunks"), F.col("content_mode"), F.lit(0)))
    own = own.withColumn("mode", mode)
    several = F.col("mode").isin("micro-multi", "multi")
    speaker = several & (F.coalesce("speaker_hint", F.lit("")) != "skip") & ~F.col("speaker").isin("ready", "skipped")
    ready, told = F.col("extraction") == "ready", F.col("tldr") == "ready"
    blocked = F.array_compact(F.array(F.when(speaker, "speaker_identification"), F.when(~ready, "extraction"), F.when(several & ~told, "tldr")))
    return own.withColumns(
        {
            "next_action": next_action(F.coalesce("speaker_hint", F.lit("")), F.col("speaker"), F.col("extraction"), F.col("tldr"), F.col("assemble")),
            "resume": F.coalesce("reused", F.lit(False)) | F.coalesce("_begun", F.lit(False)),
            "run_speaker": speaker,
            "run_extraction": ~ready,
            "run_tldr": several & ready & ~told,
            "tldr_strategy": tldr_strategy(F.col("mode")),
            "rename_speakers": several & ready & ~told & (F.coalesce("speaker_hint", F.lit("")) != "skip"),
            "blocked_by": blocked,
            "run_assemble": (F.col("assemble") != "ready") & (F.size(blocked) == 0),
        }
    ).drop("_begun")


def artifact_counts(files: DataFrame) -> DataFrame:
    """A row per work: how many files of each kind there are."""
    kinds = {"blocks": r"^chunk_.+_block_.+\.md$", "manifests": r"^manifest_chunk_.+\.tsv$", "summaries": r"^summary_chunk_.+\.md$", "html": r"\.html$"}
    flags = {"has_tldr": "tldr.md", "has_header": "header.md", "has_appendix": "appendix.md", "has_speakers": "speakers.txt"}
    return files.groupBy("work_id").agg(*[F.count_if(F.col("name").rlike(p)).alias(k) for k, p in kinds.items()], *[F.bool_or(F.col("name") == n).alias(k) for k, n in flags.items()])


def normalised_plan(items: DataFrame) -> DataFrame:
    """Plan items (chunk_id or id, ...) with one id; those without go."""
    ids = [F.col(c).cast("string") for c in ("chunk_id", "id") if c in items.columns]
    return items.withColumn("chunk_id", X.blank_to_null(X.strip(X.first_filled(*ids)))).filter("chunk_id is not null")


def pending(plan: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("work_id", "chunk_id", "chunk_fingerprint")) -> DataFrame:
    """Planned work that isn't done in this very state."""
    return plan.join(done.select(*keys).distinct(), list(keys), "left_anti")


def reusable(current: DataFrame, prepared: DataFrame, key: str = "fingerprint") -> DataFrame:
    return current.join(prepared.select(key).distinct(), key, "left_semi")


def newer_sources(derived: DataFrame, sources: DataFrame) -> DataFrame:
    """Works whose derived file is missing or older than any source (work_id, modified)."""
    newest = sources.groupBy("work_id").agg(F.max("modified").alias("_newest"))
    own = newest.join(derived.select("work_id", F.col("modified").alias("_made")), "work_id", "left")
    return own.filter(F.col("_made").isNull() | (F.col("_newest") > F.col("_made"))).select("work_id")


def change_flags(runs: DataFrame, by: str = "note_id", order: tuple[str, ...] = ("finished_at", "run_id")) -> DataFrame:
    """Each run with what differs from the note's run before; runs: transcript, markdown, html (hashes), quality, delivery (JSON, null without)."""
    w = Window.partitionBy(by).orderBy(*order)
    names = ("transcript", "markdown", "html", "quality", "delivery")
    before = {c: F.lag(c).over(w) for c in names}
    first = F.row_number().over(w) == 1
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    differs = lambda *cs: F.expr("false") if not cs else _any([~F.col(c).eqNullSafe(before[c]) for c in cs])
    own = runs.withColumns(
        {
            "first_run": first,
            "input_changed": F.when(first, filled("transcript")).otherwise(differs("transcript")),
            "output_changed": F.when(first, filled("markdown") | filled("html")).otherwise(differs("markdown", "html")),
            "quality_changed": F.when(first, filled("quality")).otherwise(differs("quality")),
            "delivery_changed": F.when(first, filled("delivery")).otherwise(differs("delivery")),
        }
    )
    changed = F.col("input_changed") | F.col("output_changed") | F.col("quality_changed") | F.col("delivery_changed")
    return own.withColumn("only_resume", ~F.col("first_run") & ~changed)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def latest_state(rows: DataFrame, by: str, order: tuple[str, ...]) -> DataFrame:
    """The last row of each key; an aggregation, so that a key of very many rows is combined before the shuffle."""
    rest = [c for c in rows.columns if c != by]
    best = rows.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(by, *[F.col(f"_r.{c}").alias(c) for c in rest])


def already_delivered(notes: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Notes (title, path, chat, sha256) whose very content went to their chat before; an unknown chat or hash of the earlier delivery matches any."""
    d = deliveries.filter("success").select(F.col("title").alias("_t"), F.col("path").alias("_p"), F.col("chat").alias("_c"), F.col("sha256").alias("_h"))
    same = (X.strip("title") == X.strip("_t")) & (F.col("path") == F.col("_p"))
    chat = (F.coalesce("chat", F.lit("")) == "") | (F.coalesce("_c", F.lit("")) == "") | (F.col("chat") == F.col("_c"))
    content = (F.coalesce("_h", F.lit("")) == "") | (F.col("sha256") == F.col("_h"))
    return notes.join(d, same & chat & content, "left_semi")


def status_payload(stages: DataFrame, statuses: DataFrame, files: DataFrame) -> DataFrame:
    """A row per work: plan, chunk rollup and artifact counts."""
    return execution_plan(stages, statuses).join(extraction_rollup(statuses).drop("extraction"), "work_id", "left").join(artifact_counts(files).drop("has_tldr", "has_speakers"), "work_id", "left")


def loaded_state(works: DataFrame, states: DataFrame, plans: DataFrame, reports: DataFrame) -> DataFrame:
    """work_id and each field of the stored state, else of the plan, else of the report (struct columns of equal names are not needed in all)."""
    own = works.select("work_id")
    fields: dict[str, list[Column]] = {}
    for k, source in enumerate((states, plans, reports)):
        columns = [c for c in source.columns if c != "work_id"]
        own = own.join(source.select("work_id", *[F.col(c).alias(f"_{k}_{c}") for c in columns]), "work_id", "left")
        for c in columns:
            fields.setdefault(c, []).append(F.col(f"_{k}_{c}"))
    return own.select("work_id", *[F.coalesce(*cs).alias(c) for c, cs in fields.items()])


def delivery_summary(deliveries: DataFrame) -> DataFrame:
    """work_id and the filled fields of a delivery, as a map of texts."""
    names = [c for c in ("enabled", "attempted", "success", "reason", "chat", "file_sha256", "error") if c in deliveries.columns]
    pairs = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))) for c in names]))
    return deliveries.select("work_id", F.map_from_entries(pairs).alias("delivery"))


def timeline(runs: DataFrame) -> DataFrame:
    """A row per run in the order of the log, with its change flags: runs as change_flags takes them, with command, status and title."""
    flags = ("first_run", "input_changed", "output_changed", "quality_changed", "delivery_changed", "only_resume")
    own = change_flags(runs)
    hashes = F.struct("transcript", "markdown", "html")
    return own.select("finished_at", "run_id", "note_id", "command", "status", "title", hashes.alias("hashes"), "quality", "delivery", F.struct(*flags).alias("change_flags"))
