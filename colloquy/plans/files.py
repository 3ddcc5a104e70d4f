"""Queries over files that are landed from the driver's tables in the shared folder and read back from there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.plans.landed import pick
from colloquy.plans.views import scratch, table
from colloquy.sources import delimited as D
from colloquy.sources import outbox as OB
from colloquy.sources import pages as PG
from colloquy.sources import readers as RD
from colloquy.sources import stores as SO

QUERIES: dict = {}
#: Documents of one file.
A_FILE = 100
#: Bytes of a range, small enough that the files of the smallest tables have several.
SMALL_RANGE = 64_000


def query(f):
    QUERIES[f.__name__] = f
    return f


def text_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder of part=n/*.txt files: documents by id, A_FILE of them each, with line ends of eight kinds."""
    ends = ("\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), pick(F.col("doc_id"), *ends))
    d = table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.floor(F.col("doc_id") / A_FILE).alias("part"), "doc_id", text.alias("text"))
    folder = scratch(spark, "texts")
    d.repartition("part").sortWithinPartitions("part", "doc_id", "text").select("part", "text").write.partitionBy("part").text(folder)
    return folder


def part_of(path: str) -> Column:
    return F.regexp_extract(path, r"part=(\d+)/", 1).cast("long")


@query
def file_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files that are read in ranges, numbered through each file."""
    lines = SO.read_line_ranges(spark, text_files(spark, sf_dir), SMALL_RANGE)
    return lines.groupBy(part_of("doc_id").alias("part")).agg(
        F.count("*").alias("lines"),
        F.sum(F.col("line_no") * F.length("text")).cast("long").alias("weighed"),
        F.max_by("text", "line_no").alias("last_line"),
    )


@query
def whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as whole texts."""
    texts = RD.read_texts(spark, f"{text_files(spark, sf_dir)}/part=*/*.txt")
    return texts.select(part_of("doc_id").alias("part"), "bytes", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha256"))


@query
def copied_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed files copied to another folder, with the digests of both sides."""
    folder, target = text_files(spark, sf_dir), scratch(spark, "copies")
    listed = RD.list_files(spark, f"{folder}/part=*", (".txt",))
    todo = listed.select("path", "bytes", F.concat(F.lit(f"{target}/part="), part_of("path").cast("string"), F.lit("/copy.txt")).alias("target"))
    SO.copy_files(todo).write.parquet(f"{target}-told")
    told = spark.read.parquet(f"{target}-told").select(part_of("target").alias("part"), "bytes", "sha256")
    again = SO.file_hashes(spark, f"{target}/part=*", (".txt",)).select(part_of("path").alias("part"), F.col("sha256").alias("copy_sha256"))
    return told.join(again, "part")


def cell_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of A_FILE documents each, as CSV writers make them: whole texts in quoted cells, names that repeat or are
    empty, rows of all lengths, and line ends of three kinds."""
    k = F.col("doc_id")

    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))

    text = F.concat(F.coalesce("text", F.lit("")), pick(k, "", "\ta", '\n"b"\n', "\r\n\n", '"'))
    row = F.when(k % 5 == 0, F.concat_ws("\t", F.lit("b"), F.lit('to"pic'))).when(k % 5 == 1, F.concat_ws("\t", F.concat(F.lit("b"), k.cast("string")), F.lit("first"), quoted(text), F.lit("x"), F.lit("last"), F.lit("beyond"), F.lit("it")))
    row = F.coalesce(row, F.concat_ws("\t", quoted(k.cast("string")), F.lit('"to"pic'), quoted(text), F.lit(""), F.concat(F.lit('"c""'), k.cast("string"), F.lit('"'))))
    ended = F.concat(row, pick(F.floor(k / A_FILE), "\n", "\r\n", "\r"))
    part = F.floor(k / A_FILE)
    d = table(spark, sf_dir, "documents").filter("doc_id is not null").select(part.alias("part"), "doc_id", ended.alias("row"))
    one = d.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "row"))), lambda s: s["row"]), "").alias("rows"))
    header = F.concat(F.lit("block_file\ttopic\tquote_text\t\ttopic\t"), pick(F.col("part"), "\n", "\r\n", "\r"))
    return one.select(F.concat(F.lit("/w/manifest_chunk_"), F.col("part").cast("string"), F.lit(".tsv")).alias("doc_id"), F.concat(header, F.col("rows")).alias("text"))


@query
def manifest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest cells that hold whole texts, read back."""
    rows = RD.manifests_of(D.raw_lines(cell_files(spark, sf_dir)))
    return rows.select("chunk_id", F.col("row_no").cast("long").alias("row_no"), "block_file", "topic", F.length("quote_text").cast("long").alias("chars"), F.sha2("quote_text", 256).alias("sha256"))


@query
def natural_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of A_FILE documents each, numbered in natural order."""
    k = F.col("doc_id")
    n = k.cast("string")
    name = pick(k, ".n", "lesson", "lesson", "lesson", "lessonb", "lesson-")
    own = table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.floor(k / A_FILE).alias("part"), F.concat(name, pick(F.floor(k / 6), "", "00"), n, pick(k, "", "~", "", ".tar.gz", ".md", "")).alias("name"))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(X.version_key("name"))).cast("long"))


@query
def published_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes published three times, the last time changed in part: the ledger has each content once."""
    path, schema = scratch(spark, "outbox"), "doc_id long, title string, sha256 string"
    d = table(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    notes = d.select("doc_id", "title", F.sha2("text", 256).alias("sha256"))
    changed = d.select("doc_id", "title", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    for rows in (notes, notes, changed):
        OB.publish(rows, path)
    return OB.ledger(spark, path, schema)


@query
def html_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes (headings that repeat, the whole text's letters as paragraphs, a nested list, a table) and these as HTML pages."""
    k = F.col("doc_id").cast("string")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\n .,]", " ")
    parts = [F.concat(F.lit("# Note "), k), F.concat(F.lit("## Part & "), F.col("doc_id") % 3), text, F.concat(F.lit("- one\n  - two *"), k, F.lit("*\n  1. three\n- four")), F.concat(F.lit("## Part & "), F.col("doc_id") % 3), F.concat(F.lit("| x | y |\n|---|--:|\n| "), k, F.lit(" | `2` |"))]
    notes = table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.col("doc_id").alias("work_id"), F.concat_ws("\n\n", *parts).alias("note"))
    pages = PG.note_pages(notes)
    return pages.select(F.col("work_id").alias("doc_id"), "title", F.length("html").cast("long").alias("chars"), F.sha2("html", 256).alias("sha256"))
