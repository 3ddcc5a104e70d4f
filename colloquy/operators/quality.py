"""Quality of finished notes: counts, ratios and coverage over a note's lines, and the gate against its contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.functions import text as X
from colloquy.operators.contract import density_targets, longform_targets, minutes


def populated_sections(lines: DataFrame) -> DataFrame:
    """work_id, meaning_blocks and case_blocks: third-level sections of the two kinds that hold any text."""
    t = X.strip("text")
    rows = lines.withColumn("_t", t).withColumn("_h", F.col("_t").rlike(r"(?U)^###\s+"))
    rows = rows.withColumn("_section", F.sum(F.col("_h").cast("int")).over(Window.partitionBy("work_id").orderBy("line_no")))
    own = rows.filter("_section > 0").groupBy("work_id", "_section").agg(F.max(F.when(F.col("_h"), F.col("_t"))).alias("_head"), F.count_if(~F.col("_h") & (F.col("_t") != "")).alias("_filled"))
    own = own.filter("_filled > 0")
    return own.groupBy("work_id").agg(F.count_if(F.col("_head").rlike(r"(?U)^###\s+Смысл блока:\s*$")).alias("meaning_blocks"), F.count_if(F.col("_head").rlike(r"(?U)^###\s+Кейс:\s*(.+?)\s*$")).alias("case_blocks"))


def duplicate_case_titles(lines: DataFrame) -> DataFrame:
    """work_id and the case titles seen more than once, in order of their second sighting."""
    title = F.lower(X.squeeze(F.regexp_extract("text", r"(?U)^###\s+Кейс:\s*(.+?)\s*$", 1)))
    rows = lines.select("work_id", "line_no", title.alias("title")).filter("title <> ''")
    again = rows.withColumn("_n", F.row_number().over(Window.partitionBy("work_id", "title").orderBy("line_no"))).filter("_n = 2")
    return again.groupBy("work_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "title"))), lambda s: s["title"]).alias("titles"))


def action_columns() -> list[Column]:
    """Aggregates over _a, the checklist actions of lines: items, verbish_items, ratio and ok."""
    n, verbs = F.count("_a"), F.count_if(F.col("_a").rlike(L.ACTION_VERB))
    ratio = F.when(n > 0, F.round(verbs / n, 2)).otherwise(1.0)
    return [n.alias("items"), verbs.alias("verbish_items"), ratio.alias("ratio"), (ratio >= 0.6).alias("ok")]


def actionability(lines: DataFrame) -> DataFrame:
    """work_id, items, verbish_items, ratio and ok of checklist actions."""
    return lines.withColumn("_a", X.checklist_action("text")).groupBy("work_id").agg(*action_columns())


def header_columns(required: tuple[str, ...] = L.HEADER_LABELS) -> list[Column]:
    """Aggregates over lines: header_complete and missing_header_fields."""

    def any_line(pattern: str) -> Column:
        return F.coalesce(F.bool_or(F.col("text").rlike(pattern)), F.lit(False))

    labels = [any_line(rf"(?U)^\*\*{x}:\*\*\s+\S") for x in required]
    frame = any_line(rf"(?U)^##\s+{L.AUTHOR_FRAME}\s*$")
    missing = F.array_compact(F.array(*[F.when(~f, F.lit(x)) for x, f in zip((*required, L.AUTHOR_FRAME), (*labels, frame), strict=True)]))
    return [(any_line(r"(?U)^\s*#\s+\S") & any_line(r"(?U)^\s*>\s+\S") & (F.size(missing) == 0)).alias("header_complete"), missing.alias("missing_header_fields")]


def header_check(lines: DataFrame, required: tuple[str, ...] = L.HEADER_LABELS) -> DataFrame:
    """work_id, header_complete and missing_header_fields."""
    return lines.groupBy("work_id").agg(*header_columns(required))


def placeholder_column() -> Column:
    """An aggregate over lines: the kinds of placeholders that leaked into them."""
    kinds = (("Speaker N", r"(?U)\bSpeaker\s+\d+\b"), ("—", r"(?U)^\s*-\s+\*\*[—-]\*\*"), ("unknown", r"(?iuU)\bunknown\b"))
    return F.array_compact(F.array(*[F.when(F.bool_or(F.col("text").rlike(p)), F.lit(name)) for name, p in kinds])).alias("placeholder_hits")


def placeholder_hits(lines: DataFrame) -> DataFrame:
    """work_id and the kinds of placeholders that leaked into the note."""
    return lines.groupBy("work_id").agg(placeholder_column())


def density(words: Column, blocks: Column, seconds: Column) -> Column:
    """blocks_per_10min, words_per_min (null without a duration) and ok against the targets."""
    m = minutes(seconds)
    target = density_targets(seconds)
    per_10, per_minute = F.when(m > 0, F.round(blocks / m * 10, 2)), F.when(m > 0, F.round(words / m, 2))
    ok = F.coalesce((per_10 >= target["min_blocks_per_10min"]) & (per_minute >= target["min_words_per_min"]), F.lit(True))
    return F.struct(per_10.alias("blocks_per_10min"), per_minute.alias("words_per_min"), target["min_blocks_per_10min"].alias("min_blocks_per_10min"), target["min_words_per_min"].alias("min_words_per_min"), ok.alias("ok"))


def tldr_check(count: Column, low: Column, high: Column) -> Column:
    """Whether the number of take-aways is within bounds; a bound of 0 is none."""
    return ((low <= 0) | (count >= low)) & ((high <= 0) | (count <= high))


def final_quality(lines: DataFrame, works: DataFrame) -> DataFrame:
    """A row per note. lines: work_id, line_no, text. works: work_id, block_count, tldr_count, duration_seconds, contract (null without)."""
    rows = lines.withColumn("_a", X.checklist_action("text"))
    told = rows.groupBy("work_id").agg(F.sum(X.word_count("text")).alias("word_count"), *header_columns(), placeholder_column(), F.struct(*action_columns()).alias("actionability"))
    own = works
    for part in (told, duplicate_case_titles(lines).withColumnRenamed("titles", "duplicate_case_titles"), populated_sections(lines)):
        own = own.join(part, "work_id", "left")
    own = own.fillna(0, ["word_count", "meaning_blocks", "case_blocks", "tldr_count"])
    tldr = F.col("contract.tldr")
    target = longform_targets(F.col("block_count"), F.col("contract.blocks"))
    deep_ok = ~F.coalesce(target["enabled"], F.lit(False)) | ((F.col("meaning_blocks") >= target["min_meaning_blocks"]) & (F.col("case_blocks") >= target["min_case_blocks"]))
    return own.withColumns(
        {
            "header_complete": F.coalesce("header_complete", F.lit(False)),
            "tldr_length_ok": tldr_check(F.col("tldr_count"), F.coalesce(tldr["min_items"], F.lit(0)), F.coalesce(tldr["max_items"], F.lit(0))),
            "duplicate_case_titles": F.coalesce("duplicate_case_titles", F.array().cast("array<string>")),
            "density": density(F.col("word_count"), F.col("block_count"), F.col("duration_seconds")),
            "longform": F.struct(target.alias("targets"), deep_ok.alias("ok")),
        }
    )


def contract_errors(quality: DataFrame) -> DataFrame:
    """quality with contract_errors, in fixed order; none without an enforced contract."""
    missing = F.array_join(F.col("missing_header_fields"), ", ")
    messages = [
        F.when(~F.col("header_complete"), F.concat(F.lit("header contract failed: missing "), X.first_filled(missing, F.lit("required fields")))),
        F.when(~F.col("tldr_length_ok"), "tldr contract failed: takeaway count outside note contract bounds"),
        F.when(F.size("placeholder_hits") > 0, F.concat(F.lit("placeholder leakage detected: "), F.array_join("placeholder_hits", ", "))),
        F.when(F.size("duplicate_case_titles") > 0, "duplicate case titles detected across chunk boundaries"),
        F.when(~F.col("actionability.ok"), "action plan failed actionability threshold"),
        F.when(F.col("longform.targets.enabled") & ~F.col("longform.ok"), "deep longform coverage is too thin: add more cases and intermediate conclusions"),
        F.when(~F.col("density.ok"), "note is too compressed for source duration"),
    ]
    found = F.array_compact(F.array(*messages))
    enforced = F.coalesce(F.col("contract.enforce_on_assemble"), F.lit(False))
    return quality.withColumn("contract_errors", F.when(enforced, found).otherwise(F.array().cast("array<string>")))


def assemble_outcome(errors: Column, shell_code: Column) -> Column:
    """Exit code of an assembly: the shell's if it failed, 2 for contract errors, else 0."""
    return F.when(shell_code != 0, shell_code).when(F.size(errors) > 0, 2).otherwise(0)


def run_status(errors: Column, shell_code: Column) -> Column:
    return F.when(shell_code != 0, "failed").when(F.size(errors) > 0, "contract-failed").otherwise("assembled")


def delivery_reason(errors: Column, skip: Column, chat: Column, delivered: Column) -> Column:
    """Why a note isn't delivered; null where it is to be."""
    known = F.coalesce(chat, F.lit("")) != ""
    failed = F.when(skip, "skipped-by-request").when(known, "contract-errors").otherwise("disabled")
    return F.when(F.size(errors) > 0, failed).when(skip, "skipped-by-request").when(delivered, "already-delivered-current-html").when(~known, "disabled")


def quality_summary(quality: DataFrame) -> DataFrame:
    """The flat fields that runs are compared by."""
    return quality.select(
        "work_id", "contract_errors", "header_complete", "tldr_count", "tldr_length_ok", (F.size("placeholder_hits") == 0).alias("placeholder_ok"), (F.size("duplicate_case_titles") == 0).alias("duplicate_case_titles_ok"),
        F.col("actionability.ok").alias("actionability_ok"), F.col("density.ok").alias("detail_density_ok"), F.col("longform.ok").alias("deep_longform_ok"),
    )


# Checks of blocks


def shallow_blocks(blocks: DataFrame, least: int = 6) -> DataFrame:
    """Blocks with fewer numbered theses than `least`."""
    theses = F.size(F.filter(X.split_lines("body"), lambda x: x.rlike(r"(?U)^\s*[0-9]+\.")))
    return blocks.withColumn("theses", theses).filter(F.col("theses") < least)


def coverage_gaps(rows: DataFrame, by: str = "work_id", order: str = "row_no", most: int = 300) -> DataFrame:
    """Rows that start over `most` seconds after the last known end before them (start_s, end_s; a missing end carries the earlier one on)."""
    w = Window.partitionBy(by).orderBy(order)
    before = F.last("end_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("gap_s", F.col("start_s") - before).filter(F.col("gap_s") > most)


def boundary_duplicates(blocks: DataFrame, by: str = "work_id", order: tuple[str, ...] = ("chunk_id", "block_no")) -> DataFrame:
    """Blocks whose topic repeats that of the block before, from another chunk."""
    w = Window.partitionBy(by).orderBy(*order)
    return blocks.withColumns({"_t": F.lag("topic").over(w), "_c": F.lag("chunk_id").over(w)}).filter("topic <> '' and _t = topic and _c <> chunk_id").drop("_t", "_c")


def quote_and_case_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("work_id").agg(F.count_if(F.col("text").rlike(r"(?U)^\s*>\s")).alias("quotes"), F.count_if(F.col("text").rlike(r"(?U)^###\s+Кейс:")).alias("cases"))
