"""What the agents of each stage are told: prompts of speaker identification, extraction, take-aways and header.

Fields stand as `KEY: value` lines; the rules are in this library's own words, filled in from plan and contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X

SPEAKER_RULES = """
Rules:
- Evidence in this order: names in file names, introductions, then who asks and who answers.
- One mapping a line, in plain text: Speaker N → name; people without a marker: Unmarked lines → name.
- Keep Speaker N where the evidence is too weak. A lone speaker of a video may be its author.
"""
EXTRACTION_RULES = """
Rules:
- Write in Russian, keep Speaker N as it is, and add nothing that the source doesn't say.
- Extract from the extraction zone only; the context zone is for orientation.
- Cut blocks where the meaning turns. A block says in its title what it shows, and its theses carry times *(MM:SS)*.
- Leave out filler. Quote at most as told, word for word. The summary holds 5 to 7 numbered ideas.
"""
TLDR_RULES = """
Rules:
- A numbered list in Russian and nothing else, from summaries and manifests only.
- As many points as the bounds allow; points that say nearly the same become one.
"""
HEADER_RULES = """
Rules:
- A title that names the topic, one quoted line of abstract, the metadata lines above as they are.
- Then the author's frame in three bullets. No placeholders.
"""
DEEP = "- The recording is long: cover it in full, with turning points, interim conclusions and cases of their own.\n"
MEANING = {"expected": "in every block", "preferred": "in most blocks", "optional": "where it is clear"}


def field(key: str, value: Column) -> Column:
    return F.concat(F.lit(f"{key}: "), F.coalesce(value.cast("string"), F.lit("unknown")), F.lit("\n"))


def sentinel(work: Column, stage: str, rest: Column | None = None) -> Column:
    """The line that asks for the sentinel once all outputs are written."""
    name = F.lit(stage) if rest is None else F.concat(F.lit(f"{stage}-"), rest)
    return F.concat(F.lit("When all is written, write "), work, F.lit("/.stages/"), name, F.lit(f'.json with stage "{stage}", outputs, completed and completed_at.\n'))


def speaker_prompts(works: DataFrame) -> DataFrame:
    w = F.col("work_id")
    text = F.concat(field("STAGE", F.lit("speaker-identification")), field("WORK_DIR", w), field("READ", F.concat(w, F.lit("/prescan_context.txt, "), w, F.lit("/header_seed.json"))), field("OUTPUT", F.concat(w, F.lit("/speakers.txt"))), F.lit(SPEAKER_RULES), sentinel(w, "speaker-identification"))
    return works.select("work_id", F.lit("speaker-identification").alias("stage"), F.lit("").alias("chunk_id"), text.alias("prompt"))


def extraction_prompts(plan: DataFrame, contracts: DataFrame) -> DataFrame:
    """A prompt for each chunk of plan, under the contract of its work (work_id, contract)."""
    own = plan.join(contracts.select("work_id", "contract"), "work_id")
    blocks, w, c = F.col("contract.blocks"), F.col("work_id"), F.col("chunk_id")
    zone = lambda a, b: F.when(F.col(a).isNull(), "none").otherwise(F.format_string("lines %d to %d", a, b))
    meaning = None
    for level, where in MEANING.items():
        meaning = F.when(blocks["meaning_section"] == level, where) if meaning is None else meaning.when(blocks["meaning_section"] == level, where)
    seconds = F.col("approx_duration_seconds")
    head = [
        field("STAGE", F.lit("extraction")), field("WORK_DIR", w), field("CHUNK_ID", c), field("FILE", F.col("doc_id")), field("READ RANGE", zone("read_start", "read_end")), field("CONTEXT ZONE", zone("context_start", "context_end")),
        field("EXTRACTION ZONE", zone("extraction_start", "extraction_end")), field("TARGET TOKENS", F.col("estimated_tokens")), F.when(seconds > 0, field("APPROX CHUNK DURATION", X.mmss(seconds))).otherwise(""), field("CHUNK FINGERPRINT", F.col("chunk_fingerprint")),
        field("MODE", F.col("contract.execution_mode")), field("MIN BLOCKS", F.greatest(F.lit(1), F.col("min_blocks"))), field("THESES", F.concat_ws("-", blocks["theses_min"].cast("string"), blocks["theses_max"].cast("string"))), field("MEANING", F.concat(blocks["meaning_section"], F.lit(", "), meaning)),
        field("CASES", blocks["case_section"]), field("QUOTES", blocks["quote_max_per_block"]),
        field("OUTPUTS", F.concat(F.lit("chunk_"), c, F.lit("_block_NN.md, manifest_chunk_"), c, F.lit(".tsv, summary_chunk_"), c, F.lit(".md"), F.when(F.col("contract.execution_mode") == "single", ", tldr.md").otherwise(""))),
    ]
    one = F.when(F.col("min_blocks") > 1, "- A single block is too little for this chunk.\n").otherwise("- A single block will do only if the material is narrow.\n")
    deep = F.when(blocks["detail_profile"] == "deep_longform", DEEP).otherwise("")
    text = F.concat(*head, F.lit(EXTRACTION_RULES), one, deep, sentinel(w, "extraction", c))
    return own.select("work_id", F.lit("extraction").alias("stage"), "chunk_id", text.alias("prompt"))


def tldr_prompts(contracts: DataFrame) -> DataFrame:
    w, tldr = F.col("work_id"), F.col("contract.tldr")
    text = F.concat(field("STAGE", F.lit("tldr")), field("WORK_DIR", w), field("READ", F.concat(w, F.lit("/summary_chunk_*.md and manifests"))), field("TAKEAWAYS", F.concat_ws("-", tldr["min_items"].cast("string"), tldr["max_items"].cast("string"))), field("OUTPUT", F.concat(w, F.lit("/tldr.md"))), F.lit(TLDR_RULES), sentinel(w, "tldr"))
    return contracts.select("work_id", F.lit("tldr").alias("stage"), F.lit("").alias("chunk_id"), text.alias("prompt"))


def header_prompts(seeds: DataFrame, contracts: DataFrame) -> DataFrame:
    """seeds: work_id, topic_hint, duration_estimate, author_hint, video_id, source_files."""
    own = seeds.join(contracts.select("work_id", "contract"), "work_id")
    author = X.person_text("author_hint", unescaped=False)
    files = X.blank_to_null(F.array_join(F.filter(F.transform("source_files", X.strip), lambda x: x != ""), ", "))
    source = F.coalesce(F.concat(F.lit("https://www.youtube.com/watch?v="), X.blank_to_null(F.col("video_id"))), files, F.lit("локальный источник"))
    lines = [
        F.when(X.is_person(author), F.concat(F.lit("**Автор:** "), author)),
        F.concat(F.lit("**Формат:** "), F.col("contract.header.format_label")),
        F.concat(F.lit("**Тема:** "), F.coalesce(X.blank_to_null(X.title_text("topic_hint", unescaped=False)), F.lit("по содержанию"))),
        F.concat(F.lit("**Длительность:** "), F.coalesce(X.blank_to_null(X.strip("duration_estimate")), F.lit("unknown"))),
        F.concat(F.lit("**Источник:** "), source),
    ]
    w = F.col("work_id")
    text = F.concat(field("STAGE", F.lit("header")), field("WORK_DIR", w), field("OUTPUT", F.concat(w, F.lit("/header.md"))), F.lit("\n"), F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n"), F.lit(HEADER_RULES), sentinel(w, "header"))
    return own.select("work_id", F.lit("header").alias("stage"), F.lit("").alias("chunk_id"), text.alias("prompt"))


def prompt_packs(plan: DataFrame, contracts: DataFrame, seeds: DataFrame) -> DataFrame:
    """work_id, stage, chunk_id, prompt: all prompts of all works."""
    return speaker_prompts(contracts.select("work_id")).unionByName(extraction_prompts(plan, contracts)).unionByName(tldr_prompts(contracts)).unionByName(header_prompts(seeds, contracts))
