"""Speaker names: applying a work's mappings to its texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(c: Column) -> Column:
    """A text as a pattern that matches itself."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|#&~<>\-])", r"\\$1")


def rename_speakers(texts: DataFrame, speaker_map: DataFrame, text: str = "text") -> DataFrame:
    """texts (work_id, ...) with every mapping of their work applied, longest pattern first, and `modified`.

    A work has few mappings; they travel as one array per work, so that a text is rewritten where it is.
    """
    maps = speaker_map.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("pattern")).alias("n"), "pattern", "replacement"))).alias("_maps"))
    own = texts.join(maps, "work_id", "left")

    def step(done: Column, m: Column) -> Column:
        pattern = F.concat(F.lit(r"(?U)\b"), quoted(m["pattern"]), F.lit(r"\b"))
        safe = F.regexp_replace(m["replacement"], r"([\\$])", r"\\$1")
        return F.regexp_replace(done, pattern, safe)

    renamed = F.when(F.col("_maps").isNull(), F.col(text)).otherwise(F.aggregate("_maps", F.col(text), step))
    return own.withColumn("_new", renamed).withColumn("modified", F.col("_new") != F.col(text)).withColumn(text, F.col("_new")).drop("_new", "_maps")


def rename_totals(renamed: DataFrame, speaker_map: DataFrame) -> DataFrame:
    """A row per work: mappings, modified texts, and whether it was skipped for want of mappings."""
    maps = speaker_map.groupBy("work_id").agg(F.count("*").alias("mappings"))
    done = renamed.groupBy("work_id").agg(F.count_if("modified").alias("modified"))
    return done.join(maps, "work_id", "left").select("work_id", "modified", F.coalesce("mappings", F.lit(0)).alias("mappings"), F.col("mappings").isNull().alias("skipped"))
