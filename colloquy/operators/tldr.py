"""Take-aways: points of chunk summaries and their stable round-robin merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as X

FALLBACK = 7
#: Parts of a round in which its first points are searched before they come together.
PARTS = 64


def summary_points(lines: DataFrame) -> DataFrame:
    """work_id, chunk_id, pos (from 0), point: bullets and numbered lines; of a summary without any, its first filled lines."""
    keys = ["work_id", "chunk_id"]
    rows = lines.select(*keys, "line_no", X.summary_point("text").alias("_bullet"), X.blank_to_null(X.squeeze("text")).alias("_line"))
    has = rows.groupBy(*keys).agg((F.count("_bullet") > 0).alias("_has"))
    points = rows.join(has, keys).withColumn("point", F.when(F.col("_has"), F.col("_bullet")).otherwise(F.col("_line"))).filter("point is not null")
    points = points.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("line_no")) - 1)
    return points.filter(F.col("_has") | (F.col("pos") < FALLBACK)).select(*keys, "pos", "point")


def target_count(files: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """How many take-aways: within the contract's bounds, else by the number of summaries."""
    plain = F.when(files <= 1, 5).when(files == 2, 7).when(files == 3, 8).when(files == 4, 9).otherwise(10)
    if low is None or high is None:
        return plain
    within = F.when(files <= low, low).otherwise(F.greatest(low, F.least(high, files * 2)))
    return F.when((low > 0) & (high > 0), within).otherwise(plain)


def merged_points(points: DataFrame, targets: DataFrame) -> DataFrame:
    """work_id, rank (from 1), point: round r takes the r-th point of each summary, in the order of files.

    points: work_id, file_no, pos, point. Points that repeat an earlier one (in any case) go; a round that adds nothing
    ends the merge; so does the target (work_id, target).

    Each round adds a point, so that only places below the target matter, and of a round's new points only the first
    `target` files'; what is left for one task is bounded by the target, not by the number of summaries.
    """
    rows = points.join(targets, "work_id").filter(F.col("pos") < F.col("target"))
    rows = rows.withColumn("point", X.strip("point")).filter("point <> ''").withColumn("_key", F.lower(X.squeeze("point")))
    first = rows.groupBy("work_id", "_key").agg(F.min(F.struct("pos", "file_no", "point")).alias("_f"), F.first("target").alias("target")).select("work_id", "_f.*", "target")
    rounds = first.select("work_id", "pos").distinct().withColumn("_round", F.row_number().over(Window.partitionBy("work_id").orderBy("pos")) - 1)
    unbroken = first.join(rounds.filter("_round = pos").select("work_id", "pos"), ["work_id", "pos"])
    part = Window.partitionBy("work_id", "pos", F.pmod(F.xxhash64("file_no"), F.lit(PARTS))).orderBy("file_no")
    few = unbroken.withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= F.col("target"))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("work_id").orderBy("pos", "file_no")))
    return ranked.filter("rank <= target").select("work_id", "rank", "point")


def tldr_text(merged: DataFrame) -> DataFrame:
    """work_id and the numbered list."""
    line = F.format_string("%d. %s", "rank", "point")
    return merged.groupBy("work_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda s: s["l"]), "\n"), F.lit("\n")).alias("tldr"))
