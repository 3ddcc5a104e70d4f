"""Operators over transcript lines: features per line and file, repeats, turns, context and the prescan sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.functions import text as X

CLUES = 15


def by_doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


def is_clue(t: Column) -> Column:
    """Whether a line tells of its speaker. Plain tests first: without a colon, `peaker` or a Cyrillic letter none does."""
    return (t.contains(":") | F.lower(t).contains("peaker") | ((F.octet_length(t) > F.length(t)) & t.rlike(L.CYRILLIC))) & t.rlike(L.SPEAKER_CLUE)


def line_features(lines: DataFrame, compat: bool = True) -> DataFrame:
    """lines with what each says about its speaker: dialogue prefix and name, introduction, clue, markers, times.

    With compat, times of 100 minutes and more (three digits) aren't seen, as in the transcripts' first readers.
    """
    t, none = F.col("text"), F.array().cast("array<string>")  # plain tests before patterns: few lines have a mark at all
    name = F.regexp_replace(F.regexp_extract(t, L.DIALOGUE_PREFIX, 1), r"^[ *_]+|[ *_]+$", "")
    return lines.withColumns(
        {
            "is_dialogue": t.contains(":") & t.rlike(L.DIALOGUE_PREFIX),
            "speaker_name": X.blank_to_null(name),
            "is_intro": (F.octet_length(t) > F.length(t)) & t.rlike(L.CYRILLIC) & t.rlike(L.INTRODUCTION),  # all introductions have such letters
            "is_clue": is_clue(t),
            "markers": F.when(t.contains("**Speaker"), F.regexp_extract_all(t, F.lit(L.SPEAKER_MARKER), F.lit(1))).otherwise(none),
            "times": F.when(t.contains("*"), F.regexp_extract_all(t, F.lit(L.TIMESTAMP if compat else L.TIMESTAMP_LONG), F.lit(1))).otherwise(none),
        }
    )


def with_sizes(lines: DataFrame) -> DataFrame:
    """lines with _chars and _words of their stripped text, once a line, for token_estimate."""
    return lines.withColumn("_stripped", X.strip("text")).withColumns({"_chars": F.length("_stripped"), "_words": X.filled_runs("_stripped")}).drop("_stripped")


def tokens_of(filled: Column, chars: Column, words: Column) -> Column:
    """Estimated tokens of lines: how many hold text, their characters and words. Line breaks between filled lines count."""
    return F.when(filled > 0, F.greatest(F.lit(1), F.bround(F.greatest((chars + filled - 1) / 4.1, words * 1.18), 0))).otherwise(0).cast("long")


def token_estimate() -> Column:
    """An aggregate over with_sizes: estimated tokens of a group's lines, 0 without any text."""
    return tokens_of(F.count_if(F.col("_chars") > 0), F.sum("_chars"), F.sum("_words"))


def file_meta(lines: DataFrame, compat: bool = True) -> DataFrame:
    """A row per file: lines, estimated_tokens, distinct markers and dialogue speakers, dialogue and introduction lines, last timestamp.

    Distinct names are found in two levels: a line's names are rows beside the line's own, equal ones meet first, and a
    file only counts what is left. So no task holds the names of a file, and the lines are read once.
    """
    f = with_sizes(line_features(lines, compat))
    kind = "array<struct<kind:string,name:string>>"
    marked = F.transform("markers", lambda m: F.struct(F.lit("marker").alias("kind"), m.alias("name")))
    named = F.when(F.col("speaker_name").isNotNull(), F.array(F.struct(F.lit("speaker").alias("kind"), F.col("speaker_name").alias("name")))).otherwise(F.array().cast(kind))
    line = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("name")))
    plain = (F.size("markers") == 0) & F.col("speaker_name").isNull()
    rows = f.withColumn("_row", F.explode(F.when(plain, line).otherwise(F.concat(line, marked, named))))
    own = F.col("_row.kind").isNull()
    last = F.max(F.when(F.size("times") > 0, F.struct("line_no", F.element_at("times", -1).alias("t"))))
    level = rows.groupBy("doc_id", "_row").agg(
        F.count_if(own).alias("_lines"), F.sum(F.when(own, F.octet_length("text") + 1)).alias("_bytes"), F.count_if(own & (F.col("_chars") > 0)).alias("_filled"), F.sum(F.when(own, F.col("_chars"))).alias("_chars"),
        F.sum(F.when(own, F.col("_words"))).alias("_words"), F.count_if(own & F.col("is_dialogue")).alias("_dialogue"), F.count_if(own & F.col("is_intro")).alias("_intro"), last.alias("_last"),
    )
    return level.groupBy("doc_id").agg(
        F.sum("_lines").alias("lines"),
        F.sum("_bytes").alias("bytes"),
        tokens_of(F.sum("_filled"), F.sum("_chars"), F.sum("_words")).alias("estimated_tokens"),
        F.count_if(F.col("_row.kind") == "marker").alias("markers"),
        F.sum("_dialogue").alias("dialogue_cues"),
        F.count_if(F.col("_row.kind") == "speaker").alias("dialogue_speakers"),
        F.sum("_intro").alias("intro_cues"),
        F.max("_last")["t"].alias("duration_estimate"),
    )


def work_totals(meta: DataFrame, order: str = "doc_id") -> DataFrame:
    """A row per work: sums over its files, and the duration of its last file that has one; sum_seconds beside it."""
    seconds = X.duration_seconds("duration_estimate")
    return meta.withColumn("_s", seconds).groupBy("work_id").agg(
        F.count("*").alias("files"),
        *[F.sum(c).alias(c) for c in ("lines", "estimated_tokens", "markers", "dialogue_cues", "dialogue_speakers", "intro_cues")],
        F.coalesce(F.max_by("_s", F.when(F.col("_s") > 0, F.col(order))), F.lit(0)).cast("long").alias("duration_seconds"),
        F.sum("_s").alias("sum_seconds"),
    )


def drop_repeated_lines(lines: DataFrame) -> DataFrame:
    """lines without consecutive repeats, blanks collapsed; unknown-word marks go first."""
    text = F.trim(F.regexp_replace(F.replace("text", F.lit("<unk>"), F.lit("")), r"[ \t]+", " "))
    clean = lines.withColumn("text", X.strip(text))
    return clean.withColumn("_before", F.lag("text").over(by_doc())).filter("_before is null or text <> _before").drop("_before")


SPEAKER_LINE = r"(?U)^(?:\*\*(.+?)\*\*|([A-Za-zА-Яа-я0-9][A-Za-zА-Яа-я0-9 .,_\-]{0,40}))\s*:\s*(.*)"
STAMP_LINE = r"^\*([^*]+)\*$"


def utterances(lines: DataFrame, compat: bool = False) -> DataFrame:
    """Turns of cleaned lines: a speaker's line, and the time below it, perhaps after a blank line.

    Lines without a speaker go on with the open turn; with compat they are dropped. A time line is part of its turn.
    """
    speaker = F.coalesce(X.blank_to_null(F.regexp_extract("text", SPEAKER_LINE, 1)), F.regexp_extract("text", SPEAKER_LINE, 2))
    one, two = F.lead("text", 1).over(by_doc()), F.lead("text", 2).over(by_doc())
    stamp = F.when(one.rlike(STAMP_LINE), F.regexp_extract(one, STAMP_LINE, 1)).when((one == "") & two.rlike(STAMP_LINE), F.regexp_extract(two, STAMP_LINE, 1))
    turn = F.col("text").rlike(SPEAKER_LINE)
    all_rows = lines.select("doc_id", "line_no", turn.alias("_turn"), X.strip(speaker).alias("speaker"), F.when(turn, X.strip(F.regexp_extract("text", SPEAKER_LINE, 3))).otherwise(F.col("text")).alias("text"), F.coalesce(stamp, F.lit("")).alias("ts"))
    if compat:
        rows = all_rows.filter("_turn").withColumn("utt_no", F.row_number().over(by_doc()))
        return rows.select("doc_id", "utt_no", "speaker", "text", "ts")
    rows = all_rows.withColumn("utt_no", F.sum(F.col("_turn").cast("int")).over(by_doc())).filter(F.col("utt_no") > 0)
    rows = rows.filter(F.col("_turn") | ((F.col("text") != "") & ~F.col("text").rlike(STAMP_LINE)))
    return rows.groupBy("doc_id", "utt_no").agg(
        F.min_by("speaker", "line_no").alias("speaker"),
        X.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), " ")).alias("text"),
        F.min_by("ts", "line_no").alias("ts"),
    )


def merge_turns(turns: DataFrame, order: str = "utt_no") -> DataFrame:
    """Fragments put together: a turn joins the one before if that has the same speaker and an open end.

    Exact also with empty texts: an empty turn that joins leaves its turn open, one that doesn't is never gone on with.
    So a turn goes on exactly if the last filled turn before it has an open end and no other speaker stands between,
    which two running values tell; a document's turns are never listed as a whole. Turns that hold only punctuation go
    afterwards.
    """
    w = Window.partitionBy("doc_id").orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    change = F.coalesce(~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) | F.lag("speaker").over(w).isNull(), F.lit(True))
    filled = F.coalesce(F.col("text") != "", F.lit(False))
    own = turns.withColumn("_run", F.sum(change.cast("int")).over(w))
    last = F.last(F.when(filled, F.struct((~F.col("text").rlike(r"[.!?…]$") & F.col("speaker").isNotNull()).alias("open"), "_run")), ignorenulls=True).over(before)
    own = own.withColumn("_last", last)
    goes_on = F.coalesce(F.col("_last.open") & (F.col("_last._run") == F.col("_run")), F.lit(False))
    return islands(own.withColumn("_joins", goes_on), order)


def islands(turns: DataFrame, order: str) -> DataFrame:
    """Turns with _joins put together: each that doesn't join starts a new one."""
    own = turns.withColumn("_island", F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(Window.partitionBy("doc_id").orderBy(order)))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), "text"))), lambda s: s["text"]), " ")
    merged = own.groupBy("doc_id", "_island").agg(F.first("speaker").alias("speaker"), texts.alias("text"), F.min_by("ts", order).alias("ts"))
    rows = merged.filter(~is_noise(F.col("text")))
    return rows.withColumn("utt_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("_island"))).drop("_island")


def merge_filled_turns(turns: DataFrame, order: str = "utt_no") -> DataFrame:
    """As merge_turns where no text is empty: only the turn before decides."""
    w = Window.partitionBy("doc_id").orderBy(order)
    goes_on = (F.lag("speaker").over(w) == F.col("speaker")) & ~F.lag("text").over(w).rlike(r"[.!?…]$")
    return islands(turns.withColumn("_joins", F.coalesce(goes_on, F.lit(False))), order)


def is_noise(text: Column) -> Column:
    return text.rlike(r"(?U)^[.\s,;:]*$")


def normalised_transcript(lines: DataFrame, compat: bool = False) -> DataFrame:
    """Cleaned, merged turns of raw transcript lines; files without any turn aren't in the result."""
    return merge_turns(utterances(drop_repeated_lines(lines), compat))


# Context


def first_clues(lines: DataFrame, most: int = CLUES) -> DataFrame:
    """The first clue lines of each file, numbered."""
    clues = lines.filter(is_clue(F.col("text")))
    return clues.withColumn("clue_no", F.row_number().over(by_doc())).filter(F.col("clue_no") <= most)


def clue_context(lines: DataFrame, most: int = CLUES, around: int = 2) -> DataFrame:
    """The lines around each of the first clues: doc_id, clue_no, line_no, mark, text. Ranges are exploded to keys, so the join stays an equi-join."""
    keys = first_clues(lines, most).select("doc_id", "clue_no", F.col("line_no").alias("_at"), F.explode(F.sequence(F.col("line_no") - around, F.col("line_no") + around)).alias("line_no"))
    return keys.join(lines, ["doc_id", "line_no"]).select("doc_id", "clue_no", "line_no", F.when(F.col("line_no") == F.col("_at"), ">>>").otherwise("   ").alias("mark"), X.strip("text").alias("text"))


def clue_texts(lines: DataFrame) -> DataFrame:
    """doc_id and its clues as texts."""
    row = F.format_string("%s %d: %s", "mark", "line_no", "text")
    one = clue_context(lines).withColumn("_row", row).groupBy("doc_id", "clue_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_row"))), lambda s: s["_row"]), "\n").alias("_clue"))
    return one.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("clue_no", "_clue"))), lambda s: s["_clue"]).alias("clues"))


def head(lines: DataFrame, n: int) -> DataFrame:
    return lines.filter(F.col("line_no") <= n)


def with_count(lines: DataFrame) -> DataFrame:
    """lines with n, the number of lines of the file (joined, so that no window holds a file)."""
    return lines.join(lines.groupBy("doc_id").agg(F.max("line_no").alias("n")), "doc_id")


def tail(lines: DataFrame, limit: int, n: int = 100) -> DataFrame:
    """The last n lines of files with more than limit + n."""
    return with_count(lines).filter((F.col("n") > limit + n) & (F.col("line_no") > F.col("n") - n)).drop("n")


def window_scores(lines: DataFrame, limit: int, tail_lines: int = 100, size: int = 50, windows: int = 20) -> DataFrame:
    """doc_id, offset and score of the candidate windows between head and tail: clue lines + 2 x distinct markers.

    Each line is dealt to the windows that hold it by arithmetic on its number; only lines with a clue or a marker are.
    """
    counts = lines.groupBy("doc_id").agg(F.max("line_no").alias("n"))
    middle = F.col("n") - tail_lines - limit
    spans = counts.filter(middle > size).select("doc_id", (F.col("n") - tail_lines - size).alias("_end"), F.greatest(F.lit(1), F.floor((middle - size) / windows)).cast("int").alias("_step"))
    every = spans.select("doc_id", F.explode(F.sequence(F.lit(limit), F.col("_end") - 1, F.col("_step"))).alias("offset"))
    t = F.col("text")
    markers = F.when(t.contains("**Speaker"), F.regexp_extract_all(t, F.lit(L.SPEAKER_MARKER), F.lit(1))).otherwise(F.array().cast("array<string>"))
    telling = lines.select("doc_id", "line_no", is_clue(t).alias("_clue"), markers.alias("_m")).filter("_clue or size(_m) > 0")
    # offset < line_no <= offset + size, offset = limit + k * step
    low = F.greatest(F.lit(0), F.ceil((F.col("line_no") - size - limit) / F.col("_step")))
    high = F.least(F.floor((F.col("line_no") - 1 - limit) / F.col("_step")), F.floor((F.col("_end") - 1 - limit) / F.col("_step")))
    dealt = telling.join(spans, "doc_id").withColumn("_low", low).withColumn("_high", high).filter("_low <= _high")
    dealt = dealt.withColumn("_k", F.explode(F.sequence("_low", "_high"))).withColumn("offset", (F.col("_k") * F.col("_step") + limit).cast("int"))
    scored = dealt.groupBy("doc_id", "offset").agg((F.count_if("_clue") + 2 * F.size(F.array_distinct(F.flatten(F.collect_set("_m"))))).alias("score"))
    return every.join(scored, ["doc_id", "offset"], "left").select("doc_id", "offset", F.coalesce("score", F.lit(0)).cast("long").alias("score"))


def densest_window(lines: DataFrame, limit: int, **options: int) -> DataFrame:
    """doc_id, offset and score of the best window; of equal ones the first."""
    best = window_scores(lines, limit, **options).groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("offset")).alias("_o"))).alias("b"))
    return best.select("doc_id", (-F.col("b._o")).alias("offset"), "b.score")


def prescan(lines: DataFrame, limit: int, size: int = 50, tail_lines: int = 100) -> DataFrame:
    """The sample that is read before planning: doc_id, section (1 head, 2 tail, 3 densest, 4 clues), part, line_no, text.

    part: the clue's number in section 4, else 0; sections are in the order of part and line_no.
    """
    best = densest_window(lines, limit, tail_lines=tail_lines, size=size)
    keys = best.select("doc_id", F.explode(F.sequence(F.col("offset") + 1, F.col("offset") + size)).alias("line_no"))
    middle = lines.join(keys, ["doc_id", "line_no"])
    parts = [(1, head(lines, limit)), (2, tail(lines, limit, tail_lines)), (3, middle)]
    out = None
    for section, part in parts:
        own = part.select("doc_id", F.lit(section).alias("section"), F.lit(0).alias("part"), "line_no", "text")
        out = own if out is None else out.unionByName(own)
    clues = clue_context(lines).select("doc_id", F.lit(4).alias("section"), F.col("clue_no").alias("part"), "line_no", F.concat_ws(" ", "mark", "text").alias("text"))
    return out.unionByName(clues)


# Titles


def topic_hint(lines: DataFrame, most: int = 80) -> DataFrame:
    """doc_id and the first of its first lines that says something, as a title."""
    titled = head(lines, most).withColumn("_title", X.title_text("text")).filter(X.is_title("_title"))
    return titled.groupBy("doc_id").agg(F.min_by("_title", "line_no").alias("topic_hint"))


def local_title(files: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id and title of local files (doc_id, stem, parent): first heading or line that says something, else from the path."""
    said = lines.withColumn("_title", X.title_text("text")).filter(X.is_title("_title")).withColumn("_h", F.col("text").rlike(L.HEADING_1))
    first = said.groupBy("doc_id").agg(F.min(F.struct("line_no", "_title", "_h")).alias("f"))
    stem, parent = X.path_title("stem"), X.path_title("parent")
    generic = F.col("stem").rlike(L.GENERIC_STEM) & X.is_title(parent)
    chosen = F.when(F.col("f").isNotNull(), F.when(~F.col("f._h") & generic, parent).otherwise(F.col("f._title")))
    return files.join(first, "doc_id", "left").select("doc_id", F.coalesce(chosen, F.when(X.is_title(stem), stem), F.when(X.is_title(parent), parent), X.blank_to_null(X.title_text("stem")), F.col("stem")).alias("title"))


def title_candidates(author: Column, chapters: Column, hints: Column) -> Column:
    """At most six titles: the author, three chapters, then hints; each once."""
    names = F.filter(F.array(X.person_text(author, unescaped=False)), X.is_person)
    titles = F.concat(names, F.slice(F.coalesce(chapters, F.array().cast("array<string>")), 1, 3), F.coalesce(hints, F.array().cast("array<string>")))
    cleaned = F.filter(F.transform(titles, lambda x: X.title_text(x, unescaped=False)), X.is_title)
    return F.slice(X.first_distinct(cleaned), 1, 6)
