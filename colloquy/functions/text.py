"""Scalar functions over text, times and names, as Column expressions.

Only unescaping, slugs and JSON merges need Python (Arrow-batched); everything else stays in the JVM.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from colloquy.functions import lexicons as L

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it; the value holds no Python function."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: What the pattern (?U)\\s matches: the white space of Unicode.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    """Without white space at either end, of any Unicode kind; looks at the ends only."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def filled_runs(c: Column | str) -> Column:
    """How many runs of characters that aren't white space a text has, without listing them."""
    return let(squeeze(c), lambda t: F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else an empty text."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


def split_lines(c: Column | str) -> Column:
    """The lines of a text, without an empty one after a last line break."""
    cut = lambda parts: F.slice(parts, 1, F.when(F.element_at(parts, -1) == "", F.size(parts) - 1).otherwise(F.size(parts)))
    return let(F.split(col(c), LINE_BREAK, -1), cut)


def any_of(words: tuple[str, ...], c: Column) -> Column:
    """Whether c holds any of the words."""
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def count_of(words: tuple[str, ...], c: Column) -> Column:
    """How many of the words c holds."""
    return reduce(lambda a, b: a + b, [c.contains(w).cast("int") for w in words])


def starts_with_any(words: tuple[str, ...], c: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(w) for w in words])


def first_distinct(items: Column) -> Column:
    """An array without later entries that differ from an earlier one in case only."""
    pairs = F.transform(items, lambda x: F.struct(x.alias("x"), F.lower(x).alias("k")))
    first = let(pairs, lambda p: F.filter(p, lambda x, i: F.array_position(p["k"], x["k"]) == i + 1))
    return first["x"]


# Times


def vtt_seconds(c: Column | str) -> Column:
    """Seconds of `SS`, `MM:SS.mmm` or `HH:MM:SS.mmm`; 0.0 if it isn't one."""
    p = F.split(col(c), ":")
    last = F.try_element_at(p, F.lit(-1)).try_cast("double")
    first = F.try_element_at(p, F.lit(1)).try_cast("int")
    found = F.when(F.size(p) == 1, last).when(F.size(p) == 2, first * 60 + last)
    found = found.otherwise(first * 3600 + F.try_element_at(p, F.lit(2)).try_cast("int") * 60 + F.try_element_at(p, F.lit(3)).try_cast("double"))
    return F.coalesce(found, F.lit(0.0))


def whole_seconds(c: Column | str) -> Column:
    """Seconds as a number cut to a whole one, at least 0; null if it isn't a number."""
    n = col(c).cast("string").try_cast("double").cast("long")
    return F.when(n < 0, 0).otherwise(n)


def mmss(c: Column | str) -> Column:
    """`MM:SS`, with more than two digits of minutes where needed; `00:00` if it isn't a number."""
    s = whole_seconds(c)
    return F.when(s.isNull(), "00:00").otherwise(F.format_string("%02d:%02d", F.floor(s / 60), s % 60))


def hhmmss(c: Column | str) -> Column:
    """`[HH:]MM:SS`, `unknown` if it isn't a number."""
    s = whole_seconds(c)
    short = F.format_string("%02d:%02d", F.floor(s % 3600 / 60), s % 60)
    return F.when(s.isNull(), "unknown").when(s >= 3600, F.concat(F.format_string("%02d:", F.floor(s / 3600)), short)).otherwise(short)


def duration_seconds(c: Column | str) -> Column:
    """Seconds of `MM:SS` or `HH:MM:SS`, else 0."""
    p = F.transform(F.split(col(c), ":"), lambda x: strip(x).try_cast("int"))
    three = F.try_element_at(p, F.lit(1)) * 3600 + F.try_element_at(p, F.lit(2)) * 60 + F.try_element_at(p, F.lit(3))
    two = F.try_element_at(p, F.lit(1)) * 60 + F.try_element_at(p, F.lit(2))
    return F.coalesce(F.when(F.size(p) == 3, three).when(F.size(p) == 2, two), F.lit(0))


# Languages


def subtitle_language(file_name: Column | str) -> Column:
    code = F.regexp_extract(col(file_name), L.SUBTITLE_LANGUAGE, 1)
    return blank_to_null(F.lower(F.element_at(F.split(code, "-"), 1)))


def language_code(name: Column | str) -> Column:
    """A language's code from its name, as caption services give it."""
    low = F.lower(col(name))
    return F.when(low == "", None).when(low.contains("russian") | low.startswith("ru"), "ru").when(low.contains("english") | low.startswith("en"), "en").otherwise(F.substring(low, 1, 2))


def language_hint(c: Column | str) -> Column:
    low = F.lower(strip(c))
    return F.when(~low.isin("", "auto"), low)


# Text from markup


@pandas_udf(StringType())
def unescape_any(texts: pd.Series) -> pd.Series:
    """HTML character references as characters."""
    return texts.map(lambda x: html.unescape(x) if isinstance(x, str) and "&" in x else x)


#: Character references that are replaced without Python; that of the ampersand comes last, so that none is read twice.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def unescape(c: Column | str) -> Column:
    """Text without HTML character references; only texts with other ones than REFERENCES go to Python."""
    rest = replaced = col(c)
    for name, sign in REFERENCES.items():
        rest, replaced = F.replace(rest, F.lit(name), F.lit(" ")), F.replace(replaced, F.lit(name), F.lit(sign))
    other = rest.contains("&")
    return F.when(other, unescape_any(F.when(other, col(c)))).otherwise(replaced)


def clean_caption(lines: Column) -> Column:
    """The text of a caption's lines."""
    stripped = F.filter(F.transform(lines, strip), lambda x: x != "")
    return squeeze(unescape(F.regexp_replace(F.array_join(stripped, " "), L.TAG, "")))


@pandas_udf(StringType())
def slug(texts: pd.Series) -> pd.Series:
    """A file name part: ASCII letters and digits joined by hyphens, at most 72 characters, `notes` if none remain."""

    def one(text: str | None) -> str:
        plain = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()
        kept = "-".join(re.findall("[a-z0-9]+", plain))
        return kept[:72].rstrip("-") or "notes"

    return texts.map(one)


@pandas_udf(StringType())
def merge_json(base: pd.Series, patch: pd.Series) -> pd.Series:
    """JSON objects merged at every depth; the patch wins, its nulls included, and lists are replaced whole."""

    def merged(a: dict, b: dict) -> dict:
        both = {k: merged(a[k], b[k]) for k in a.keys() & b.keys() if isinstance(a[k], dict) and isinstance(b[k], dict)}
        return {k: both.get(k, b[k] if k in b else a[k]) for k in [*a, *[k for k in b if k not in a]]}

    def one(a: str | None, b: str | None) -> str:
        return json.dumps(merged(json.loads(a or "{}"), json.loads(b or "{}")), ensure_ascii=False)

    return pd.Series([one(a, b) for a, b in zip(base, patch, strict=True)])


def merge_maps(base: Column, patch: Column) -> Column:
    """String maps merged, the patch wins with its nulls; needs no session setting."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(patch), k))
    return F.map_concat(kept, patch)


# Titles and people


def title_text(c: Column | str, unescaped: bool = True) -> Column:
    """A line as a title: no tags, heading mark, leading timestamps, speaker, emphasis or leading punctuation; at most 140."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), L.TAG, "")
    text = strip(unescape(text) if unescaped else text)
    text = F.regexp_replace(text, L.HEADING_1, "$1")
    text = F.regexp_replace(text, L.TITLE_TIMESTAMPS, "")
    text = F.regexp_replace(text, L.TITLE_SPEAKER, "")
    text = F.regexp_replace(text, r"__|[`*]", "")
    text = F.regexp_replace(text, r"(?U)^[>\-–—•\s:;,.]+", "")
    return F.trim(F.substring(squeeze(text), 1, 140))


def person_text(c: Column | str, unescaped: bool = True) -> Column:
    """A name from metadata: as a title, without @, at most 80."""
    text = strip(F.regexp_replace(title_text(c, unescaped), "^@", ""))
    return F.trim(F.substring(F.regexp_replace(squeeze(text), r"^[ \-|]+|[ \-|]+$", ""), 1, 80))


def path_title(c: Column | str, unescaped: bool = True) -> Column:
    """A folder or file stem as a title."""
    text = F.regexp_replace(strip(F.coalesce(col(c), F.lit(""))), r"^[A-Za-z0-9_-]{11}-", "")
    text = F.regexp_replace(text, r"(?i)^\d{4}-\d{2}-\d{2}-[a-f0-9]{6,}$", "")
    text = F.regexp_replace(text, r"(?i)-[a-f0-9]{8,}$", "")
    text = F.regexp_replace(squeeze(F.translate(text, "_-", "  ")), r"^[ .\-_]+|[ .\-_]+$", "")
    return title_text(F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30)), unescaped)


def is_title(c: Column | str) -> Column:
    """Whether a title says something."""
    return strip(F.coalesce(col(c), F.lit(""))).rlike(L.INFORMATIVE_TITLE)


def is_person(c: Column | str) -> Column:
    """Whether a name can be one."""
    return strip(F.coalesce(col(c), F.lit(""))).rlike(L.INFORMATIVE_PERSON)


def is_placeholder(c: Column | str) -> Column:
    """Whether an entity stands for nobody."""
    return squeeze(F.coalesce(col(c), F.lit(""))).rlike(L.PLACEHOLDER)


def people(c: Column | str) -> Column:
    """Names of two or three capitalised words, each once."""
    found = F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(L.PERSON), F.lit(0)), squeeze)
    return first_distinct(F.filter(found, lambda x: F.length(x) >= 4))


def video_id(url: Column | str) -> Column:
    return blank_to_null(F.regexp_extract(col(url), L.VIDEO_ID, 1))


def is_video_url(c: Column | str) -> Column:
    return col(c).contains("youtube.com/") | col(c).contains("youtu.be/")


def author_hint(creator: Column, uploader: Column, channel: Column, artist: Column, handle: Column, unescaped: bool = True) -> Column:
    """The first name in metadata that can be one, else the handle; null without any."""
    names = [person_text(c, unescaped) for c in (creator, uploader, channel, artist, handle)]
    return F.coalesce(*[F.when(is_person(n), n) for n in names[:-1]], F.when(is_person(names[-1]), names[-1]))


def speaker_candidates(creator: Column, uploader: Column, channel: Column, artist: Column, unescaped: bool = True) -> Column:
    """The names in metadata that can be one, each once; written out, as array functions don't take Python functions."""
    names = [person_text(c, unescaped) for c in (creator, uploader, channel, artist)]
    kept = []
    for i, n in enumerate(names):
        new = is_person(n)
        for before in names[:i]:
            new = new & (F.lower(before) != F.lower(n))
        kept.append(F.when(new, n))
    return F.array_compact(F.array(*kept))


# Statements, topics, actions


def statement(c: Column | str) -> Column:
    """A thesis without its bold lead, dash, trailing reference and full stops."""
    text = squeeze(F.coalesce(col(c), F.lit("")))
    text = F.regexp_replace(text, r"^\*\*[^*]+\*\*\s*:?\s*", "")
    text = F.regexp_replace(text, r"^[—–-]\s*", "")
    text = F.regexp_replace(text, r"\s*\*\([^)]+\)\*\s*$", "")
    return F.trim(F.regexp_replace(text, r"\.+$", ""))


def limit_text(c: Column | str, most: int = 140) -> Column:
    cut = lambda t: F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))
    return let(squeeze(F.coalesce(col(c), F.lit(""))), cut)


def topic_tokens(c: Column | str) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(L.TOKEN), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*L.TOPIC_STOP_WORDS))


def long_tokens(c: Column | str) -> Column:
    """Tokens of four letters or more, stop words included: for texts whose tokens then meet those of topics."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(L.LONG_TOKEN), F.lit(0))


def split_values(c: Column | str) -> Column:
    """The entries of a multi-valued manifest cell."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), r"[;|,]\s*"), strip)
    return F.filter(parts, lambda x: ~x.isin("", *L.DASHES))


def action_candidate(c: Column | str) -> Column:
    """What follows a marker word and a colon, else the whole statement; without quotation marks."""

    def bare(x: Column) -> Column:
        return F.regexp_replace(strip(x), '^[«»"]+|[«»"]+$', "")

    def chosen(text: Column) -> Column:
        at = F.locate(":", text)
        rest = F.when(at > 0, squeeze(bare(F.substring(text, at + 1, F.length(text)))))
        marked = any_of(L.ACTION_PREFIX_MARKERS, F.lower(F.substring(text, F.lit(1), at - 1)))
        return F.when(marked, F.coalesce(blank_to_null(rest), text)).otherwise(text)

    return F.regexp_replace(bare(let(statement(c), chosen)), r"\.+$", "")


def imperative(c: Column | str) -> Column:
    """An action as a request."""

    def request(text: Column) -> Column:
        first = F.lower(F.regexp_replace(F.element_at(F.split(text, " "), 1), '^[«»".,:;!?]+|[«»".,:;!?]+$', ""))
        rest = F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))
        out = F.when((text == "") | first.isin(*L.IMPERATIVES), text)
        for word, prefix in L.IMPERATIVE_PREFIXES:
            out = out.when(F.lower(text).contains(word), F.concat(F.lit(prefix), rest))
        return out.otherwise(text)

    return let(action_candidate(c), request)


def action_score(c: Column | str) -> Column:
    """How much a text asks for an action."""
    told = lambda low: 2 * count_of(L.STRONG_ACTION, low) + count_of(L.WEAK_ACTION, low) - 2 * count_of(L.NO_ACTION, low)
    shape = lambda text: (text.contains("?") | text.contains("«")).cast("int") - (F.length(text) > 220).cast("int")
    return let(col(c), lambda text: let(F.lower(text), told) + shape(text))


def action_term(text: Column) -> Column:
    """immediate, ongoing or month, by the words of an action."""

    def chosen(low: Column) -> Column:
        out = F.when(any_of(L.IMMEDIATE_WORDS, low) | starts_with_any(L.IMMEDIATE_STARTS, low), "immediate")
        return out.when(any_of(L.ONGOING_WORDS, low) | starts_with_any(L.ONGOING_STARTS, low), "ongoing").otherwise("month")

    return let(F.lower(text), chosen)


def action_bucket(c: Column | str) -> Column:
    """As action_term; null for what is no action."""
    return let(col(c), lambda text: F.when(action_score(text) >= 2, action_term(text)))


def summary_point(line: Column | str) -> Column:
    """The text of a bullet or numbered line; null for other lines."""
    return blank_to_null(squeeze(F.regexp_extract(col(line), L.SUMMARY_LINE, 1)))


def checklist_action(line: Column | str) -> Column:
    return blank_to_null(squeeze(F.regexp_extract(col(line), L.CHECKLIST_LINE, 1)))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(r"[\p{L}\p{M}\p{N}_'-]+"))


# Hashes, names and references


#: Letters of a short hash.
SHORT = 12


def short_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, SHORT)


def chunk_label(index: Column, letters: int = 8) -> Column:
    """A, B, ..., Z, AA, AB, ... for 0, 1, ...; up to `letters` letters (over 200 billion chunks)."""
    start = F.struct(index.cast("long").alias("n"), F.lit("").alias("label"))

    def step(state: Column, _: Column) -> Column:
        letter = F.concat(F.char(state["n"] % 26 + 65), state["label"])
        open_ = state["n"] >= 0
        return F.struct(F.when(open_, F.floor(state["n"] / 26).cast("long") - 1).otherwise(F.lit(-1).cast("long")).alias("n"), F.when(open_, letter).otherwise(state["label"]).alias("label"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(letters)), start, step, lambda s: s["label"])


def label_order(label: Column | str) -> Column:
    """Natural order of labels: shorter ones first."""
    return F.struct(F.length(col(label)), col(label))


def collapse_blank_lines(c: Column | str) -> Column:
    return F.regexp_replace(strip(c), "\n{3,}", "\n\n")


def delivery_name(c: Column | str, suffix: str) -> Column:
    text = strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), "[\r\n]+", " "))
    text = F.regexp_replace(text, r'[<>:"/\\|?*]+', " ")
    text = F.regexp_replace(squeeze(text), r"^[ .]+|[ .]+$", "")
    text = F.when(text == "", "Конспект").otherwise(text)
    return F.concat(F.regexp_replace(F.substring(text, 1, 120), "[ .]+$", ""), F.lit(suffix))


def note_id(existing: Column, kind: Column, video: Column, chat: Column, message: Column, path: Column, url: Column, bundle: Column) -> Column:
    """The id of a note: what it has, else from the first of its sources that is known."""
    existing, kind, video, chat, message, path, url = (blank_to_null(strip(c)) for c in (existing, kind, video, chat, message, path, url))
    return F.coalesce(
        existing,
        F.when((kind == "youtube") & video.isNotNull(), F.concat(F.lit("youtube:"), video)),
        F.when((kind == "telegram") & chat.isNotNull() & message.isNotNull(), F.concat_ws(":", F.lit("telegram"), chat, message)),
        F.when(path.isNotNull(), F.concat(F.lit("file:"), F.sha1(path))),
        F.when(url.isNotNull(), F.concat(F.lit("url:"), F.sha1(url))),
        F.concat(F.lit("bundle:"), F.sha1(bundle)),
    )


def external_refs(*lists: Column) -> Column:
    """Entries separated by commas or line feeds, each once, in order."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(c, F.lit("")), "[\n,]+") for c in lists]))
    return F.array_distinct(F.filter(F.transform(parts, strip), lambda x: x != ""))


def source_reference(kind: Column, url: Column, name: Column) -> Column:
    kind, url, name = (strip(F.coalesce(c, F.lit(""))) for c in (kind, url, name))
    local = F.when((kind == "local") & (name != ""), F.concat(F.lit("Файл: "), name))
    return F.when((kind == "youtube") & (url != ""), url).otherwise(F.coalesce(local, first_filled(url, name)))


def caption(title: Column, kind: Column, url: Column, name: Column) -> Column:
    """The text that announces a note."""
    reference = blank_to_null(source_reference(kind, url, name))
    head = F.when(kind == "youtube", "📝 Конспект видео: ").when(kind == "local", "📝 Конспект материала: ").otherwise("📝 Конспект: ")
    return F.concat_ws("\n", F.concat(head, title), F.when(kind.isin("youtube", "local"), reference))


def source_hint_lines(author: Column, candidates: Column, channel: Column, uploader: Column, handle: Column) -> Column:
    """Lines that name a recording's likely author; an empty array where nothing is known."""
    author, channel, uploader, handle = (blank_to_null(strip(F.coalesce(c, F.lit("")))) for c in (author, channel, uploader, handle))
    identity = blank_to_null(F.concat_ws(", ", channel, uploader))
    line = F.when(identity.isNotNull() & handle.isNotNull(), F.concat(identity, F.lit(" ("), handle, F.lit(")"))).otherwise(F.coalesce(identity, handle))
    lines = F.array_compact(
        F.array(
            F.lit("=== SOURCE IDENTITY HINTS ==="),
            F.concat(F.lit("Primary author/uploader hint: "), author),
            F.when(F.size(candidates) > 0, F.concat(F.lit("Speaker candidates from source metadata: "), F.array_join(candidates, ", "))),
            F.concat(F.lit("YouTube channel/uploader metadata: "), line),
            F.lit("If the transcript is a single-speaker YouTube monologue, prefer this real name over generic labels like Speaker 1 or Автор."),
        )
    )
    return F.when(author.isNotNull() | (F.size(candidates) > 0) | line.isNotNull(), lines).otherwise(F.array().cast("array<string>"))


# Names


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: ASCII characters that are neither letters, digits nor a tilde; in names they come after all letters.
_SIGNS = "".join(chr(i) for i in range(128) if not chr(i).isalnum() and chr(i) != "~")


def _part_key(name: Column) -> Column:
    """A text that sorts as the name's parts do: runs of digits by value, letters before signs, the end before both, a tilde before the end."""
    signs = F.translate(name, _SIGNS + "~", "".join(chr(128 + ord(c)) for c in _SIGNS) + "\x01")
    coded = F.regexp_replace(signs, "([^\\x00-ÿ])", "Ā$1")

    def one(part: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(part, "[0-9]*\\z", 0), "^0+", "")
        return F.concat(F.regexp_replace(part, "[0-9]+\\z", ""), F.lit("\x02"), F.lpad(F.length(digits).cast("string"), 6, "0"), digits)

    return F.array_join(F.transform(F.regexp_extract_all(coded, F.lit("([^0-9]*+[0-9]*+)"), F.lit(1)), one), "")


def version_key(c: Column | str) -> Column:
    """What file names are sorted by in natural (version) order: numbers by value, `~` before everything, suffixes last; of names
    that are equal so far the bytes decide. Empty names, `.`, `..` and hidden ones come first."""
    name = F.coalesce(col(c), F.lit(""))
    kind = F.when(name == "", 0).when(name == ".", 1).when(name == "..", 2).when(name.startswith("."), 3).otherwise(4)
    stem = F.regexp_replace(name, r"(?:\.[A-Za-z~][A-Za-z0-9~]*+)++\z", "")
    return F.struct(kind.alias("kind"), _part_key(stem).alias("stem"), _part_key(name).alias("whole"), name.alias("name"))
