"""The appendix of a note: people, resources, actions and key ideas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.functions import text as X
from colloquy.sources.shared import kept

FEW = 5


def block_candidates(lines: DataFrame) -> DataFrame:
    """Theses, dated bullets and conclusions of blocks, with the topic of their block.

    lines: work_id, block_key (its order within the work), line_no, text. Topic is the first heading of the block; theses
    count from a heading `### Тезисы` to the next third-level one.
    """
    w = Window.partitionBy("work_id", "block_key").orderBy("line_no")
    t = F.regexp_replace("text", r"(?U)\s+$", "")
    first_heading = F.regexp_extract(t, r"(?U)^\s*#\s*Блок\s+\d+\s*:\s*(.+)$", 1)
    second_heading = F.regexp_extract(t, r"(?U)^\s*##\s+(.+?)(?:\s+\([0-9:–-]+\))?\s*$", 1)
    heading = X.blank_to_null(X.squeeze(X.first_filled(first_heading, second_heading)))
    theses = t.rlike(r"(?U)^\s*###\s+Тезисы")
    third = t.rlike(r"(?U)^\s*###\s+")
    rows = lines.withColumn("_t", t).withColumn("topic", F.first(heading, ignorenulls=True).over(w))
    rows = rows.withColumn("_in", F.last(F.when(theses, True).when(third, False), ignorenulls=True).over(w)).filter(~theses)
    numbered = F.regexp_extract("_t", r"(?U)^\s*\d+\.\s+(.+)$", 1)
    bullet = F.regexp_extract("_t", r"(?U)^\s*[-*]\s*(?:\*\([^)]+\)\*\s*)?(.+)$", 1)
    verdict = F.regexp_extract("_t", r"(?U)^\s*\*\*Вывод:\*\*\s*(.+)$", 1)
    candidate = F.when(F.coalesce("_in", F.lit(False)) & (numbered != ""), numbered).when((bullet != "") & F.col("_t").rlike(r"\*\([^)]+\)\*"), bullet).otherwise(verdict)
    return rows.select("work_id", "block_key", "line_no", "topic", X.statement(candidate).alias("statement")).filter("statement <> ''")


def block_topics(lines: DataFrame) -> DataFrame:
    """work_id, block_key, topic: the first heading of each block that has one."""
    t = F.col("text")
    heading = X.first_filled(F.regexp_extract(t, r"(?U)^\s*#\s*Блок\s+\d+\s*:\s*(.+?)\s*$", 1), F.regexp_extract(t, r"(?U)^\s*##\s+(.+?)(?:\s+\([0-9:–-]+\))?\s*$", 1))
    return lines.withColumn("_h", X.blank_to_null(X.squeeze(heading))).filter("_h is not null").groupBy("work_id", "block_key").agg(F.min_by("_h", "line_no").alias("topic"))


def topic_counts(manifest: DataFrame, blocks: DataFrame) -> DataFrame:
    """work_id, topic, n and first_seen, of manifest topics and block headings. Manifest rows come first."""
    rows = manifest.select("work_id", X.squeeze(F.coalesce("topic", F.lit(""))).alias("topic"), F.struct(F.lit(0).alias("s"), F.length("chunk_id").alias("a"), F.col("chunk_id").alias("b"), F.col("row_no").cast("long").alias("c")).alias("_seen"))
    own = blocks.select("work_id", "topic", F.struct(F.lit(1).alias("s"), F.lit(0).alias("a"), F.lit("").alias("b"), F.col("block_key").cast("long").alias("c")).alias("_seen"))
    return rows.unionByName(own).filter("topic <> ''").groupBy("work_id", "topic").agg(F.count("*").alias("n"), F.min("_seen").alias("first_seen"))


def top_topics(counts: DataFrame, most: int = 8) -> DataFrame:
    """The most frequent topics of each work; of equal ones those seen first."""
    w = Window.partitionBy("work_id").orderBy(F.desc("n"), "first_seen")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def topic_descriptions(manifest: DataFrame, candidates: DataFrame) -> DataFrame:
    """work_id, topic and its first description: claims and cases of manifest rows, then statements of blocks."""
    order = [F.length("chunk_id").alias("a"), F.col("chunk_id").alias("b"), F.col("row_no").cast("long").alias("c")]
    claims = manifest.select("work_id", "topic", X.statement("primary_claim").alias("d"), F.struct(F.lit(0).alias("s"), *order, F.lit(0).alias("k")).alias("o"))
    cases = manifest.select("work_id", "topic", F.concat(F.lit(L.CASE_PREFIX), X.blank_to_null(X.squeeze("case_title"))).alias("d"), F.struct(F.lit(0).alias("s"), *order, F.lit(1).alias("k")).alias("o"))
    said = candidates.select("work_id", "topic", F.col("statement").alias("d"), F.struct(F.lit(1).alias("s"), F.lit(0).alias("a"), F.lit("").alias("b"), F.col("block_key").cast("long").alias("c"), F.col("line_no").alias("k")).alias("o"))
    return claims.unionByName(cases).unionByName(said).filter("topic <> '' and d <> ''").groupBy("work_id", "topic").agg(F.min_by("d", "o").alias("description"))


#: Lines of a topic that are scored first, for a bound on its best score.
TRIED = 16


def best_lines(topics: DataFrame, lines: DataFrame) -> DataFrame:
    """work_id, topic and the line that shares most tokens with it, the first of equal ones; topics without any shared token go.

    lines: work_id, pos (of any type with an order, a line each), line. First the lines that share most of a topic's rarest
    third are scored exactly; the best of them scores `least`. A line that scores as much shares one of the m - least + 1
    rarest of the topic's m tokens at least, so only these are joined with the lines. A topic's most common token is never
    joined: where `least` is 1 it matters only alone, and its first line stands for all. Of the lines that are met, those
    that can still win are scored exactly by their own tokens.
    """
    named = topics.select("work_id", "topic").distinct()
    named = named.withColumn("_t", F.struct(F.xxhash64("topic"), F.hash("topic")))  # 96 bits for a topic, so that its text isn't shuffled
    wanted = kept(named.select("work_id", "_t", F.explode(F.array_distinct(X.topic_tokens("topic"))).alias("_token")), "wanted")
    had = lines.select("work_id", "pos", F.explode(F.array_distinct(X.long_tokens("line"))).alias("_token"))
    places = kept(had.join(wanted.select("work_id", "_token").distinct(), ["work_id", "_token"], "left_semi"), "places")
    found = places.groupBy("work_id", "_token").agg(F.count("*").alias("_lines"))
    own = Window.partitionBy("work_id", "_t")
    ranked = wanted.join(found, ["work_id", "_token"]).withColumns({"_rank": F.row_number().over(own.orderBy("_lines", "_token")), "_m": F.count("*").over(own)})
    ranked = kept(ranked.drop("_lines"), "ranked")

    def met(tokens: DataFrame, *beside: str) -> DataFrame:
        joined = tokens.select("work_id", "_t", *beside, "_token").join(places, ["work_id", "_token"])
        return joined.groupBy("work_id", "_t", *beside, "pos").agg(F.count("*").alias("_c"))

    def shared(some: DataFrame) -> DataFrame:
        return some.select("work_id", "_t", "pos").join(places, ["work_id", "pos"]).join(wanted, ["work_id", "_t", "_token"])

    rare = met(ranked.filter((F.col("_rank") <= F.ceil(F.col("_m") / 3)) & (F.col("_rank") < F.col("_m"))))
    tried = kept(rare.withColumn("_try", F.row_number().over(own.orderBy(F.desc("_c"), "pos"))).filter(F.col("_try") <= TRIED), "tried")
    least = shared(tried).groupBy("work_id", "_t", "pos").agg(F.count_distinct("_token").alias("_k")).groupBy("work_id", "_t").agg(F.max("_k").alias("_least"))
    bounded = kept(ranked.join(least, ["work_id", "_t"], "left").fillna(1, ["_least"]), "bounded")
    prefix = bounded.filter((F.col("_rank") <= F.col("_m") - F.col("_least") + 1) & (F.col("_rank") < F.col("_m")))
    counts = kept(met(prefix, "_least"), "counts")
    most = counts.groupBy("work_id", "_t").agg(F.max("_c").alias("_most"))
    unmet = F.greatest(F.col("_least") - 1, F.lit(1))  # tokens that weren't joined
    can_win = counts.join(most, ["work_id", "_t"]).filter(F.col("_c") + unmet >= F.greatest("_least", "_most")).select("work_id", "_t", "pos")
    common = bounded.filter("_rank = _m and _least = 1").select("work_id", "_t", "_token")
    first = places.join(common.select("work_id", "_token").distinct(), ["work_id", "_token"], "left_semi").groupBy("work_id", "_token").agg(F.min("pos").alias("pos"))
    can_win = kept(can_win.unionByName(common.join(first, ["work_id", "_token"]).select("work_id", "_t", "pos")).distinct(), "can_win")
    scored = shared(can_win).groupBy("work_id", "_t", "pos").agg(F.count("*").alias("_score"))
    best = scored.groupBy("work_id", "_t").agg(F.min(F.struct((-F.col("_score")).alias("less"), "pos")).alias("_b"))
    best = kept(best.select("work_id", "_t", (-F.col("_b.less")).alias("score"), F.col("_b.pos").alias("pos")), "best")
    text = lines.join(best, ["work_id", "pos"]).groupBy("work_id", "_t").agg(F.min("line").alias("line"), F.max("score").alias("score"))
    return text.join(named.select("work_id", "_t", "topic"), ["work_id", "_t"]).select("work_id", "topic", "line", "score")


def described_topics(top: DataFrame, descriptions: DataFrame, lines: DataFrame) -> DataFrame:
    """The top topics with a description: recorded, else the best summary line, else a fixed sentence."""
    own = top.join(descriptions, ["work_id", "topic"], "left").join(best_lines(top, lines).select("work_id", "topic", "line"), ["work_id", "topic"], "left")
    return own.withColumn("description", F.coalesce(F.when(F.col("description").isNotNull(), X.limit_text("description", 180)), F.when(F.col("line").isNotNull(), X.limit_text("line", 180)), F.lit(L.TOPIC_FALLBACK)))


def entity_contexts(manifest: DataFrame, column: str) -> DataFrame:
    """work_id, name, context of a multi-valued manifest column, placeholders left out."""
    context = X.first_filled(X.squeeze(F.coalesce("topic", F.lit(""))), X.squeeze(F.coalesce("block_file", F.lit(""))))
    return manifest.select("work_id", F.explode(X.split_values(column)).alias("name"), context.alias("context")).filter(~X.is_placeholder("name"))


def people_contexts(manifest: DataFrame, candidates: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """As entity_contexts for people: of manifests, of statements, and seeded ones (work_id, author_hint, speaker_candidates)."""
    said = candidates.select("work_id", F.explode(X.people("statement")).alias("name"), F.coalesce("topic", F.concat(F.lit("block "), F.col("block_key").cast("string"))).alias("context"))
    out = entity_contexts(manifest, "names").unionByName(said.filter(~X.is_placeholder("name")))
    if seeds is not None:
        author = X.squeeze(F.coalesce("author_hint", F.lit("")))
        out = out.unionByName(seeds.select("work_id", author.alias("name"), F.lit(L.AUTHOR_CONTEXT).alias("context")).filter(~X.is_placeholder("name")))
        others = seeds.select("work_id", author.alias("_author"), F.explode("speaker_candidates").alias("name")).withColumn("name", X.squeeze("name"))
        out = out.unionByName(others.filter((F.col("name") != F.col("_author")) & ~X.is_placeholder("name")).select("work_id", "name", F.lit(L.CANDIDATE_CONTEXT).alias("context")))
    return out


def entity_lines(contexts: DataFrame) -> DataFrame:
    """work_id, name and its first two contexts in one line; the two smallest are found by aggregation, no list of all is made."""
    once = contexts.select("work_id", "name", "context").distinct()
    ranked = once.withColumn("_n", F.row_number().over(Window.partitionBy("work_id", "name").orderBy("context"))).filter("_n <= 2")
    pair = F.concat_ws("; ", F.min("context"), F.max(F.when(F.col("_n") == 2, F.col("context"))))
    return ranked.groupBy("work_id", "name").agg(pair.alias("_pair")).select("work_id", "name", X.limit_text("_pair").alias("contexts"))


def action_rows(manifest: DataFrame, candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """work_id, bucket, action, o: actions in order of their source (o.s), each once over all buckets. Each table is read once.

    Manifest columns come first (o.s from 0 to 2), then statements of blocks with a score of 2 (3), summary lines with 3 (4).
    """

    def listed(rows: Column) -> Column:
        """The rows (action, bucket, ...) that are actions."""
        return F.explode(F.filter(rows, lambda r: (r["action"] != "") & r["bucket"].isNotNull()))

    told = [F.struct(F.lit(k).alias("s"), F.lit(bucket).alias("bucket"), F.coalesce(column, F.lit("")).alias("text")) for k, (column, bucket) in enumerate((("action_now", "immediate"), ("action_check", "month"), ("action_avoid", "ongoing")))]
    asked = F.transform(F.array(*told), lambda r: F.struct(r["s"].alias("s"), r["bucket"].alias("bucket"), X.let(X.imperative(r["text"]), X.imperative).alias("action")))  # requests are made of requests
    own = manifest.select("work_id", "chunk_id", "row_no", listed(asked).alias("_r"))
    place = F.struct(F.col("_r.s").alias("s"), F.length("chunk_id").alias("a"), F.col("chunk_id").alias("b"), F.col("row_no").cast("long").alias("c"), F.lit(0).cast("long").alias("d"))
    own = own.select("work_id", F.col("_r.bucket").alias("bucket"), F.col("_r.action").alias("action"), place.alias("o"))

    def placed(rows: DataFrame, s: int, action: Column, least: int, c: str, d: Column) -> DataFrame:
        at = F.struct(F.lit(s).alias("s"), F.lit(0).alias("a"), F.lit("").alias("b"), F.col(c).cast("long").alias("c"), d.cast("long").alias("d"))
        return rows.select("work_id", at.alias("o"), action.alias("_action"), F.lit(least).alias("_least"))

    said = placed(candidates, 3, F.col("statement"), 2, "block_key", F.col("line_no"))
    more = placed(lines, 4, X.statement("line"), 3, "pos", F.lit(0))
    judged = X.let(X.action_candidate("_action"), lambda a: F.struct(a.alias("action"), F.when(X.action_score(a) >= F.col("_least"), X.action_term(a)).alias("bucket")))
    found = said.unionByName(more).select("work_id", "o", listed(F.array(judged)).alias("_r"))
    found = found.select("work_id", F.col("_r.bucket").alias("bucket"), F.col("_r.action").alias("action"), "o")
    return first_by_key(own.unionByName(found))


def collected_actions(manifest: DataFrame, candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """As action_rows, with summary lines only in works with fewer than FEW actions from elsewhere."""
    rows = action_rows(manifest, candidates, lines)
    sure = rows.filter("o.s < 4").groupBy("work_id").agg(F.count("*").alias("_sure"))
    return rows.join(sure, "work_id", "left").filter((F.col("o.s") < 4) | (F.coalesce("_sure", F.lit(0)) < FEW)).drop("_sure")


def first_by_key(rows: DataFrame) -> DataFrame:
    """The first row of each action of a work, without regard to case: an aggregation, combined before the shuffle."""
    first = F.min(F.struct("o", "bucket", "action")).alias("_f")
    return rows.groupBy("work_id", F.lower("action").alias("_key")).agg(first).select("work_id", "_f.bucket", "_f.action", "_f.o")


def top_actions(actions: DataFrame) -> DataFrame:
    """The first five, five and six actions of the buckets immediate, month and ongoing, of action_rows or collected_actions.

    Summary lines stand behind all others and go where those are FEW or more: to tell this, the first six of each bucket do.
    """
    ranked = actions.withColumn("rank", F.row_number().over(Window.partitionBy("work_id", "bucket").orderBy("o"))).filter("rank <= 6")
    sure = F.count_if(F.col("o.s") < 4).over(Window.partitionBy("work_id"))  # at most 18 rows of a work
    kept = ranked.withColumn("_sure", sure).filter((F.col("o.s") < 4) | (F.col("_sure") < FEW)).drop("_sure")
    return kept.filter((F.col("bucket") == "ongoing") | (F.col("rank") <= 5))


def appendix_text(works: DataFrame, people: DataFrame, resources: DataFrame, actions: DataFrame, topics: DataFrame) -> DataFrame:
    """work_id and the appendix as Markdown. people, resources: entity_lines; actions: top_actions; topics: described_topics."""

    def listed(rows: DataFrame, line: Column, order: Column | str, name: str) -> DataFrame:
        own = rows.select("work_id", F.struct((F.col(order) if isinstance(order, str) else order).alias("o"), line.alias("l")).alias("s"))
        return own.groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["l"]), "\n").alias(name))

    entity = F.concat(F.lit("- **"), F.col("name"), F.lit(":** "), F.col("contexts"), F.lit("."))
    item = F.concat(F.lit("- [ ] "), F.col("action"))
    idea = F.concat(F.lit("- **"), X.limit_text("topic"), F.lit(":** "), F.col("description"))
    own = works.select("work_id").distinct()
    for rows, line, order, name in ((people, entity, "name", "p"), (resources, entity, "name", "r"), (topics, idea, "rank", "t")):
        own = own.join(listed(rows, line, order, name), "work_id", "left")
    for bucket in ("immediate", "month", "ongoing"):
        own = own.join(listed(actions.filter(F.col("bucket") == bucket), item, "rank", bucket), "work_id", "left")
    none = F.col("p").isNull() & F.col("r").isNull()
    entities = F.when(none, "\n- Имена и ресурсы не были явно извлечены из материалов.").otherwise(
        F.concat(F.lit("\n## Люди\n"), F.coalesce("p", F.lit("- Явно названные люди не были извлечены из материалов.")), F.lit("\n\n## Ресурсы\n"), F.coalesce("r", F.lit("- Явно названные книги, инструменты или сервисы не были извлечены из материалов.")))
    )
    any_action = F.col("immediate").isNotNull() | F.col("month").isNotNull() | F.col("ongoing").isNotNull()
    plan = F.concat_ws("\n", F.lit("\n---\n\n# План действий\n\n### Прямо сейчас"), "immediate", F.concat(F.lit("\n### На этой неделе\n"), F.col("month")), F.concat(F.lit("\n### На постоянной основе\n"), F.col("ongoing")))
    ideas = F.concat(F.lit("\n---\n\n# Ключевые идеи и модели\n"), F.coalesce("t", F.lit("- Явные модели и повторяющиеся идеи не были извлечены из материалов.")))
    return own.select("work_id", F.concat(F.concat_ws("\n", F.lit("# Упомянутые люди и ресурсы"), entities, F.when(any_action, plan), ideas), F.lit("\n")).alias("appendix"))
