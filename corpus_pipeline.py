"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir); all but the last return the columns of documents.

Language ID and quality rules drop the documents that they reject, near-dedup keeps the smallest doc_id of each group,
decontamination drops what holds a benchmark item, and BPE gives each remaining document's token digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import decontamination, language_id, near_duplicates, quality_rules
from colloquy.llm.common import dropped, table, written
from colloquy.llm.queries import bpe_digests


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs)


STAGES = [("language_id", language), ("quality_rules", quality), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("bpe", tokens)]

#: Trained classifiers, compression ratios and BPE are beyond SQL; tests hold run()'s rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written into the shared folder and read again, and goes
    when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        dropped(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
