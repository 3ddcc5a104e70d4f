"""The driver's tables as transcript tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators import lines as LN
from colloquy.sources.readers import lines_of
from colloquy.sources.shared import kept, scratch

__all__ = ["conversation_lines", "doc_lines", "scratch", "source_lines", "source_meta", "spread", "table"]

#: Documents whose line counts are summed together before sums run over the groups.
STRIDE = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores is dealt out once, as one file may be one task; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def doc_lines(spark: SparkSession, sf_dir: str, *beside: str) -> DataFrame:
    """doc_id, line_no and text of each document's lines, and columns of the document beside them."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", *beside))
    return lines_of(docs, beside=beside)


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as one transcript: the lines of its documents in order, numbered through.

    Offsets are sums in two levels (groups of documents, then documents within a group), so that no task holds all lines
    or all documents of a large source. Rows that repeat a document count as often as they stand there; rows without a
    doc_id come first, and rows without a source are a transcript without a name.
    """
    from colloquy.functions.text import split_lines

    docs = spread(table(spark, sf_dir, "documents").select("source", "doc_id", "text")).filter("text is not null")
    placed = docs.withColumns({"_g": F.floor(F.col("doc_id") / STRIDE), "_n": F.size(split_lines("text"))})
    groups = placed.groupBy("source", "_g").agg(F.sum("_n").alias("_all"))
    w = Window.partitionBy("source").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(F.col("source").alias("_source"), F.col("_g").alias("_group"), F.coalesce(F.sum("_all").over(w), F.lit(0)).alias("_base"))
    groups = kept(groups, "groups")  # of known size: where it is small it is broadcast, and texts aren't dealt a second time
    own = Window.partitionBy("source", "_g").orderBy("doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("_before", F.coalesce(F.sum("_n").over(own), F.lit(0)))
    numbered = within.join(groups, F.col("source").eqNullSafe(F.col("_source")) & F.col("_g").eqNullSafe(F.col("_group")))
    one = numbered.select(F.col("source").alias("doc_id"), (F.col("_base") + F.col("_before")).alias("_offset"), F.posexplode(split_lines("text")).alias("_pos", "text"))
    return one.select("doc_id", (F.col("_offset") + F.col("_pos") + 1).cast("int").alias("line_no"), "text")


def source_meta(lines: DataFrame) -> DataFrame:
    """File meta of sources, all of one work."""
    return LN.file_meta(lines).withColumn("work_id", F.lit("corpus"))


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a transcript of `**Speaker n**: text` lines; a role's number is its rank, a missing role's is the first."""
    c = table(spark, sf_dir, "conversations")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ")
    own = Window.partitionBy("conv_id")
    told = F.concat(F.lit("**Speaker "), F.dense_rank().over(own.orderBy("role")).cast("string"), F.lit("**: "), text)
    return c.select(F.col("conv_id").cast("string").alias("doc_id"), F.row_number().over(own.orderBy("turn")).alias("line_no"), told.alias("text"))
