"""Sinks: transcripts, notes, appendices, reports and indexes as text columns, and table writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.sources.readers import joined_in_order


def with_end(c: Column) -> Column:
    """A text with one line feed at its end; empty stays empty."""
    body = F.regexp_replace(c, r"(?U)\s+$", "")
    return F.when(body == "", "").otherwise(F.concat(body, F.lit("\n")))


def cues_to_markdown(cues: DataFrame) -> DataFrame:
    """doc_id and a transcript of `*MM:SS* text` lines."""
    line = F.concat(F.lit("*"), X.mmss("start_s"), F.lit("* "), F.col("text"))
    return cues.filter("text <> ''").withColumn("line", line).groupBy("doc_id").agg(with_end(joined_in_order("line", "cue_no", "\n")).alias("text"))


def turns_to_markdown(turns: DataFrame) -> DataFrame:
    """doc_id and a transcript of turns, each with its time below."""
    stamp = F.when(F.col("ts") != "", F.concat(F.lit("\n*"), F.col("ts"), F.lit("*"))).otherwise("")
    turn = F.concat(F.lit("**"), F.col("speaker"), F.lit("**: "), F.col("text"), stamp, F.lit("\n"))
    return turns.withColumn("line", turn).groupBy("doc_id").agg(with_end(joined_in_order("line", "utt_no", "\n")).alias("text"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def manifest_tsv(manifest: DataFrame) -> DataFrame:
    """work_id and the merged manifest as TSV: one header, then all rows by chunk in natural order and row."""
    columns = [c for c in manifest.columns if c not in ("work_id", "chunk_id", "row_no")]
    row = F.concat_ws("\t", *[F.coalesce(F.regexp_replace(F.col(c).cast("string"), "[\t\n]", " "), F.lit("")) for c in columns])
    own = manifest.withColumn("_row", row).withColumn("_order", F.struct(F.length("chunk_id"), "chunk_id", "row_no"))
    return own.groupBy("work_id").agg(F.concat(F.lit("\t".join(columns) + "\n"), with_end(joined_in_order("_row", "_order", "\n"))).alias("tsv"))


def block_text(body: Column) -> Column:
    """A block for the note: its old heading with bars rewritten, blank lines and rules at its end gone."""
    text = F.regexp_replace(body, r"(?m)^## (?:Block|Блок)[^|\n]*\|\s*([^|\n]*?)\s*\|\s*([^|\n]*?)\s*(?:\|[^\n]*)?$", "## $2 ($1)")
    return F.regexp_replace(text, r"(?:\n(?:\s*|---))*$", "")


def assembled_notes(works: DataFrame, blocks: DataFrame) -> DataFrame:
    """work_id and the note: header or title, take-aways, blocks in natural order, appendix; rules between.

    works: work_id, title, header, tldr, appendix (texts, null where missing).
    """
    own = blocks.withColumn("_text", block_text(F.col("body"))).withColumn("_order", F.struct(F.length("chunk_id"), "chunk_id", "block_no"))
    rule = "\n\n---\n\n"
    parts = own.groupBy("work_id").agg(F.concat(joined_in_order("_text", "_order", rule), F.lit(rule)).alias("_blocks"))

    def ended(c: str) -> Column:
        return F.regexp_replace(F.col(c), r"\n$", "")

    head = F.coalesce(ended("header"), F.concat(F.lit("# "), F.col("title")))
    tldr = F.when(F.col("tldr").isNotNull(), F.concat(F.lit("## Коротко о главном\n\n"), ended("tldr"), F.lit(rule))).otherwise("")
    return works.join(parts, "work_id", "left").select("work_id", F.concat(head, F.lit(rule), tldr, F.coalesce("_blocks", F.lit("")), F.coalesce("appendix", F.lit(""))).alias("note"))


def linked_times(text: Column, url: Column) -> Column:
    """Times in second-level headings as links into the recording."""
    pattern = r"\b(\d{1,2}:\d{2}(?::\d{2})?)\b"

    def line(x: Column) -> Column:
        times = F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
        rest = F.split(x, pattern, -1)
        link = F.transform(times, lambda t: F.concat(F.lit("["), t, F.lit("]("), url, F.when(url.contains("?"), "&t=").otherwise("?t="), X.duration_seconds(t).cast("string"), F.lit(")")))
        return F.when(x.startswith("## ") & (F.size(times) > 0), F.array_join(F.flatten(F.transform(F.arrays_zip(rest.alias("r"), F.concat(link, F.array(F.lit(""))).alias("l")), lambda z: F.array(z["r"], z["l"]))), "")).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")


def batch_index(results: DataFrame) -> DataFrame:
    """One row: total, ok, failed and an HTML list of the files that went well."""
    item = F.concat(F.lit("<li>"), F.when(F.col("html").isNotNull(), F.concat(F.lit('<a href="'), F.col("html"), F.lit('">'), escaped("title"), F.lit("</a>"))).otherwise(F.concat(escaped("title"), F.lit(" <span class='meta'>(no HTML)</span>"))), F.lit("</li>"))
    ok = F.col("status") == "ok"
    items = F.array_sort(F.collect_list(F.when(ok, F.struct("file", item.alias("item")))))
    return results.agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.concat(F.lit("<ol>"), F.array_join(F.transform(items, lambda s: s["item"]), ""), F.lit("</ol>")).alias("html"))


def escaped(c: str) -> Column:
    out = F.coalesce(F.col(c), F.lit("Unknown"))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def chunk_prompts(plan: DataFrame) -> DataFrame:
    """doc_id, chunk_id and what an extraction agent is told about its chunk."""
    context = F.when(F.col("context_start").isNull(), "none").otherwise(F.format_string("%d-%d", "context_start", "context_end"))
    text = F.concat_ws("\n", F.format_string("Chunk %s of %s", "chunk_id", "doc_id"), F.concat(F.lit("Context lines: "), context), F.format_string("Extract lines: %d-%d", "extraction_start", "extraction_end"), F.format_string("Blocks: at least %d", "min_blocks"), F.format_string("Mode: %s", "content_mode"), F.format_string("Outputs: manifest_chunk_%s.tsv, summary_chunk_%s.md", "chunk_id", "chunk_id"))
    return plan.select("doc_id", "chunk_id", text.alias("prompt"))


def prepare_report(plan: DataFrame, meta: DataFrame, works: DataFrame) -> DataFrame:
    """work_id and a text report of totals and chunk assignments. works: work_id, doc_id, stage, reason, mode, prescan_limit, duration."""
    context = F.when(F.col("context_start").isNull(), "none (first chunk)").otherwise(F.format_string("lines %d to %d", "context_start", "context_end"))
    chunk = F.concat_ws("\n", F.format_string("  CHUNK %s:", "chunk_id"), F.format_string("    file: %s", "doc_id"), F.concat(F.lit("    context_zone: "), context), F.format_string("    extraction_zone: lines %d to %d", "extraction_start", "extraction_end"), F.format_string("    read_range: lines %d to %d", "read_start", "read_end"), F.format_string("    target_lines: %d", "target_lines"), F.format_string("    overlap: %d", "overlap"))
    own = plan.withColumn("_text", chunk).withColumn("_order", F.struct(F.length("chunk_id"), "chunk_id")).groupBy("work_id").agg(F.count("*").alias("chunks"), joined_in_order("_text", "_order", "\n\n").alias("_chunks"))
    totals = meta.groupBy("work_id").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    both = works.join(totals, "work_id").join(own, "work_id")
    head = F.concat_ws("\n", F.lit("=== NOTES PREPARATION REPORT ==="), F.format_string("WORK_DIR: %s", "work_id"), F.format_string("Files: %d", "files"), F.format_string("Total lines: %d", "lines"), F.format_string("Duration estimate: %s", "duration"), F.format_string("Content mode: %s", "mode"), F.format_string("Speaker stage: %s (%s)", "stage", "reason"), F.format_string("Prescan limit: %d lines", "prescan_limit"))
    return both.select("work_id", F.concat(head, F.lit("\n\n=== CHUNK ASSIGNMENTS ===\n\n"), F.col("_chunks"), F.format_string("\n\n=== TOTAL CHUNKS: %d ===\n", "chunks")).alias("report"))


def prescan_text(sample: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """doc_id and the prescan sample (doc_id, section, part, line_no, text) as text: hint lines (doc_id, hint_lines array) first, then the sections, each under its heading."""
    names = F.element_at(F.array(*[F.lit(x) for x in ("FIRST LINES", "LAST LINES", "MIDDLE SAMPLE", "SPEAKER HINTS")]), F.col("section"))
    place = F.struct("part", "line_no") if "part" in sample.columns else F.col("line_no")
    parts = sample.withColumn("_place", place).groupBy("doc_id", "section").agg(joined_in_order("text", "_place", "\n").alias("_body"))
    parts = parts.withColumn("_text", F.concat(F.lit("=== "), names, F.lit(" ===\n"), F.col("_body")))
    own = parts.groupBy("doc_id").agg(joined_in_order("_text", "section", "\n\n").alias("_all"))
    if hints is None:
        return own.select("doc_id", with_end(F.col("_all")).alias("text"))
    head = F.when(F.size("hint_lines") > 0, F.concat(F.array_join("hint_lines", "\n"), F.lit("\n\n"))).otherwise("")
    return own.join(hints, "doc_id", "left").select("doc_id", with_end(F.concat(F.coalesce(head, F.lit("")), F.col("_all"))).alias("text"))


def numbered_blocks(blocks: DataFrame) -> DataFrame:
    """blocks with their number in the note: natural order of chunks, then of blocks."""
    w = Window.partitionBy("work_id").orderBy(F.length("chunk_id"), "chunk_id", "block_no")
    return blocks.withColumn("number", F.row_number().over(w))
