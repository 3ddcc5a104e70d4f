"""Note contracts: what a note of a recording must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.functions import text as X
from colloquy.operators.plan import named_video, tldr_strategy


def minutes(seconds: Column) -> Column:
    return F.when(seconds > 0, seconds / 60).otherwise(0.0)


def format_label(mode: Column) -> Column:
    out = None
    for name, label in L.FORMAT_LABELS.items():
        out = F.when(mode == name, label) if out is None else out.when(mode == name, label)
    return out.otherwise(L.FORMAT_LABEL_ELSE)


def bounds(low: int, high: int) -> Column:
    return F.struct(F.lit(low).alias("min_items"), F.lit(high).alias("max_items"))


def tldr_bounds(mode: Column, seconds: Column, chunks: Column) -> Column:
    """The fewest and most take-aways."""
    m = minutes(seconds)

    def tiers(name: str, rest: Column) -> Column:
        out = None
        for test, limit, low, high in L.TLDR_TIERS[name]:
            holds = (m > 0) & ((m <= limit) if test == "<=" else (m >= limit))
            out = F.when(holds, bounds(low, high)) if out is None else out.when(holds, bounds(low, high))
        return out.otherwise(rest)

    few, many = L.TLDR_MONOLOGUE_ELSE
    alone = tiers("monologue", F.when(chunks <= 3, bounds(*few)).otherwise(bounds(*many)))
    talk = tiers("conversation", bounds(*L.TLDR_ELSE["conversation"]))
    return F.when(mode == "monologue", alone).when(mode == "conversation", talk).otherwise(tiers("workshop", bounds(*L.TLDR_ELSE["workshop"])))


def by_mode(mode: Column, monologue: float, workshop: float, rest: float) -> Column:
    return F.when(mode == "monologue", F.lit(monologue)).when(mode == "workshop", F.lit(workshop)).otherwise(F.lit(rest))


def block_contract(seconds: Column, mode: Column) -> Column:
    """What blocks must hold, by duration."""
    m = minutes(seconds)
    workshop = mode == "workshop"
    deep, deeper = m >= 120, m >= 150
    return F.struct(
        F.when(m >= 90, 7).when(m >= 60, 6).otherwise(5).alias("theses_min"),
        F.when(deep, F.when(workshop, 11).otherwise(10)).when(m >= 90, F.when(workshop, 10).otherwise(9)).when(m >= 60, 9).otherwise(8).alias("theses_max"),
        F.when(m >= 90, "expected").when(m >= 60, "preferred").otherwise("optional").alias("meaning_section"),
        F.when(deep, "deep_longform").otherwise("standard").alias("detail_profile"),
        F.when(deep, "preferred").otherwise("optional").alias("case_section"),
        F.lit(1).alias("quote_max_per_block"),
        deep.alias("deep_enabled"),
        F.when(deeper, 5).when(deep, 4).otherwise(0).alias("min_meaning_blocks_floor"),
        F.when(deeper, 0.8).when(deep, 0.75).otherwise(0.0).alias("min_meaning_blocks_ratio"),
        F.when(deeper, by_mode(mode, 3, 5, 4)).when(deep, by_mode(mode, 2, 4, 3)).otherwise(0).alias("min_case_blocks_floor"),
        F.when(deeper, by_mode(mode, 0.25, 0.35, 0.3)).when(deep, by_mode(mode, 0.2, 0.3, 0.25)).otherwise(0.0).alias("min_case_blocks_ratio"),
    )


def density_targets(seconds: Column) -> Column:
    m = minutes(seconds)
    blocks = words = None
    for limit, per_10, per_minute in L.DENSITY_TIERS:
        blocks = F.when(m >= limit, per_10) if blocks is None else blocks.when(m >= limit, per_10)
        words = F.when(m >= limit, per_minute) if words is None else words.when(m >= limit, per_minute)
    return F.struct(blocks.otherwise(0.0).alias("min_blocks_per_10min"), words.otherwise(0).alias("min_words_per_min"))


def longform_targets(blocks: Column, contract: Column) -> Column:
    """The fewest meaning and case sections of deep notes."""

    def least(kind: str) -> Column:
        need = F.greatest(contract[f"min_{kind}_blocks_floor"].cast("int"), F.ceil(blocks * contract[f"min_{kind}_blocks_ratio"]).cast("int"))
        return F.when(contract["deep_enabled"], need).otherwise(0)

    return F.struct(contract["deep_enabled"].alias("enabled"), least("meaning").alias("min_meaning_blocks"), least("case").alias("min_case_blocks"))


def required_metadata(author: Column) -> Column:
    rest = F.array(*[F.lit(x) for x in L.HEADER_LABELS[1:]])
    return F.when(X.is_person(X.person_text(author, unescaped=False)), F.concat(F.array(F.lit(L.HEADER_LABELS[0])), rest)).otherwise(rest)


def note_contract(works: DataFrame) -> DataFrame:
    """works (content_mode, execution_mode, duration_seconds, total_chunks, author_hint) with their contract as a struct."""
    mode, seconds = F.col("content_mode"), F.col("duration_seconds")
    header = F.struct(required_metadata(F.col("author_hint")).alias("required_metadata"), F.when(mode != "monologue", F.array(F.lit("Участники"))).otherwise(F.array().cast("array<string>")).alias("optional_metadata"), format_label(mode).alias("format_label"), F.col("author_hint").alias("author_hint"), F.lit("three-bullets").alias("author_frame_style"))
    tldr = tldr_bounds(mode, seconds, F.col("total_chunks"))
    texts = lambda *a: F.array(*[F.lit(x) for x in a])
    body = ("коротко_о_главном", "основные_блоки", "упомянутые_люди_и_ресурсы")
    return works.withColumn(
        "contract",
        F.struct(
            F.lit(1).alias("schema_version"), mode.alias("content_mode"), F.col("execution_mode").alias("execution_mode"), F.lit(True).alias("enforce_on_assemble"), header.alias("header"), block_contract(seconds, mode).alias("blocks"),
            F.struct(F.lit(True).alias("required"), tldr_strategy(F.col("execution_mode")).alias("strategy"), tldr["min_items"].alias("min_items"), tldr["max_items"].alias("max_items")).alias("tldr"),
            texts("header", *body, "план_действий", "ключевые_идеи_и_модели").alias("section_order"),
            texts("title", "abstract", "metadata", "главная_рамка_автора", *body).alias("required_sections"),
            texts("план_действий", "ключевые_идеи_и_модели").alias("optional_sections"), texts("Speaker N", "—", "unknown").alias("forbidden_placeholders"),
        ),
    )


def prepare_quality(works: DataFrame) -> DataFrame:
    """works (also speaker_stage, source_kind) with what can be judged before extraction."""
    m = minutes(F.col("duration_seconds"))
    per_10 = F.when(m > 0, F.round(F.col("total_chunks") / m * 10, 2))
    expected = (F.col("content_mode") == "monologue") & named_video(F.col("source_kind"), F.col("author_hint"))
    target = density_targets(F.col("duration_seconds"))["min_blocks_per_10min"]
    return works.withColumns(
        {
            "routing_ok": F.col("speaker_stage").isin("skip", "optional", "required"),
            "fast_path_expected": expected,
            "fast_path_ok": ~expected | ((F.col("speaker_stage") == "skip") & F.col("execution_mode").isin("single", "micro-multi")),
            "blocks_per_10min": per_10,
            "min_blocks_per_10min": target,
            "fragmentation_ok": per_10.isNull() | ((per_10 >= target) & (per_10 <= 1.8)),
        }
    )
