"""DuckDB SQL of the queries over the driver's tables, and the parts that other queries' SQL is made of."""

from __future__ import annotations

from colloquy.functions import lexicons as L
from colloquy.plans.fixtures import ACTION_TEXTS, NAMES, TIMES, URLS

LINES = r"""
split AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, source, CASE WHEN parts[len(parts)] = '' THEN list_slice(parts, 1, len(parts) - 1) ELSE parts END AS ls FROM split),
dl AS (SELECT doc_id, source, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS line_no, unnest(ls) AS text FROM cut)"""
SOURCE_LINES = LINES + r""",
sl AS (SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) AS line_no, text FROM dl)"""
CONVERSATION_LINES = r"""
cl AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line_no,
  '**Speaker ' || dense_rank() OVER (PARTITION BY conv_id ORDER BY role) || '**: ' || replace(coalesce(text, ''), chr(10), ' ') AS text,
  dense_rank() OVER (PARTITION BY conv_id ORDER BY role) AS n, replace(coalesce(text, ''), chr(10), ' ') AS said FROM conversations)"""
STRIP = r"regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
TOKENS = rf"""CASE WHEN count(*) FILTER ({STRIP} <> '') = 0 THEN 0 ELSE CAST(greatest(1, round_even(greatest(
  (sum(length({STRIP})) FILTER ({STRIP} <> '') + count(*) FILTER ({STRIP} <> '') - 1) / 4.1,
  sum(len(regexp_extract_all({STRIP}, '\S+'))) FILTER ({STRIP} <> '') * 1.18), 0)) AS BIGINT) END"""
DIALOGUE = r"'^\s*(?:\*\*)?([A-Za-zА-Яа-я0-9][A-Za-zА-Яа-я0-9 .,_\-]{0,40})(?:\*\*)?\s*:'"
INTRO = r"'(?i)(меня зовут|мне зовут|расскажи про себя|расскажите про себя|представься|представьтесь|представь себя|представьте себя|я .*кодер|я .*предприниматель|я .*разработчик|кто ты такой|кто вы такой)'"
CLUE = r"'(?i)(меня зовут|мне зовут|я —|привет,?\s*я($|[^\p{L}\p{N}_])|расскажи про себя|расскажите про себя|представь(?:ся| себя)?|у нас в гостях|сегодня с нами|в гостях у нас|спасибо,?\s+[\p{L}\p{N}_]|Speaker\s+\d+|^\s*[\p{L}\p{N}_][^:\n]{0,60}:)'"
MARKER = r"'\*\*Speaker\s+(\d+)\*\*'"
TIME = r"'\*([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\*'"
NAME = rf"nullif(regexp_replace(regexp_extract(text, {DIALOGUE}, 1), '^[ *_]+|[ *_]+$', '', 'g'), '')"


def meta(lines: str) -> str:
    return rf"""
m AS (SELECT doc_id, count(*) AS lines, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, {TOKENS} AS estimated_tokens,
  CAST(coalesce(len(list_distinct(flatten(list(regexp_extract_all(text, {MARKER}, 1))))), 0) AS BIGINT) AS markers,
  count(*) FILTER (regexp_matches(text, {DIALOGUE})) AS dialogue_cues, count(DISTINCT {NAME}) AS dialogue_speakers,
  count(*) FILTER (regexp_matches(text, {INTRO})) AS intro_cues,
  arg_max(list_last(regexp_extract_all(text, {TIME}, 1)), line_no) FILTER (len(regexp_extract_all(text, {TIME}, 1)) > 0) AS duration_estimate
  FROM {lines} GROUP BY doc_id)"""


SECONDS = "CASE len(string_split(duration_estimate, ':')) WHEN 3 THEN CAST(string_split(duration_estimate, ':')[1] AS INT) * 3600 + CAST(string_split(duration_estimate, ':')[2] AS INT) * 60 + CAST(string_split(duration_estimate, ':')[3] AS INT) WHEN 2 THEN CAST(string_split(duration_estimate, ':')[1] AS INT) * 60 + CAST(string_split(duration_estimate, ':')[2] AS INT) ELSE 0 END"
WORKS = rf""",
s AS (SELECT *, 'corpus' AS work_id, {SECONDS} AS seconds FROM m),
t AS (SELECT work_id, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(estimated_tokens) AS BIGINT) AS estimated_tokens, CAST(sum(markers) AS BIGINT) AS markers, CAST(sum(dialogue_cues) AS BIGINT) AS dialogue_cues,
  CAST(sum(dialogue_speakers) AS BIGINT) AS dialogue_speakers, CAST(sum(intro_cues) AS BIGINT) AS intro_cues, CAST(coalesce(arg_max(seconds, doc_id) FILTER (seconds > 0), 0) AS BIGINT) AS duration_seconds FROM s GROUP BY work_id),
st AS (SELECT *, CASE WHEN markers >= 2 OR dialogue_cues >= 4 OR intro_cues >= 2 OR dialogue_speakers >= 3 THEN 'required' WHEN markers <= 1 AND dialogue_cues <= 1 AND dialogue_speakers <= 1 AND intro_cues <= 1 AND lines < 1200 THEN 'skip' ELSE 'optional' END AS stage0 FROM t),
cm AS (SELECT *, CASE WHEN stage0 = 'skip' AND markers <= 1 AND dialogue_cues <= 1 AND dialogue_speakers <= 1 AND intro_cues <= 1 THEN 'monologue'
  WHEN markers >= 3 OR dialogue_cues >= 8 OR intro_cues >= 3 OR (duration_seconds >= 2700 AND (dialogue_cues >= 5 OR markers >= 2)) OR (dialogue_speakers >= 3 AND intro_cues >= 1) THEN 'workshop'
  WHEN stage0 = 'required' OR markers >= 2 OR dialogue_cues >= 3 OR intro_cues >= 2 THEN 'conversation' WHEN lines >= 2200 AND duration_seconds >= 2100 THEN 'workshop' ELSE 'conversation' END AS content_mode FROM st),
w AS (SELECT * EXCLUDE (stage0), CASE WHEN content_mode = 'monologue' AND stage0 = 'optional' THEN 'skip' ELSE stage0 END AS speaker_stage FROM cm)"""


def factor(required: float, optional: float, skip: float) -> str:
    return f"CASE speaker_stage WHEN 'required' THEN {required} WHEN 'optional' THEN {optional} ELSE {skip} END"


def chunk_count(lines: str, seconds: str, tokens: str) -> str:
    """SQL of the number of chunks, from columns speaker_stage and content_mode."""
    by_lines = f"(CASE WHEN {lines} < 350 AND speaker_stage = 'skip' THEN 1 ELSE greatest(CASE WHEN {lines} >= 500 THEN 2 ELSE 1 END, ceil({lines} / greatest(350.0::DOUBLE, (500.0::DOUBLE + {lines} / 12.0::DOUBLE) * ({factor(0.92, 1.0, 1.16)})::DOUBLE))) END)"
    by_tokens = f"(CASE WHEN {tokens} > 0 AND {lines} < 2000 THEN greatest({by_lines}, least(greatest(1, ceil({tokens} / ({factor(2200, 2600, 3000)})::DOUBLE)), {by_lines} + 1)) ELSE {by_lines} END)"
    by_time = f"(CASE WHEN {seconds} > 0 THEN greatest({by_tokens}, least(greatest(1, ceil({seconds} / 60.0 / 20)), {by_lines} + 2)) ELSE {by_tokens} END)"
    cap = f"(CASE WHEN content_mode = 'monologue' THEN CASE WHEN {seconds} > 0 THEN CASE WHEN {seconds} <= 1800 THEN 2 WHEN {seconds} <= 3300 THEN 3 ELSE 4 END WHEN {lines} < 2000 THEN 2 ELSE 3 END WHEN {lines} >= 12000 THEN 12 WHEN {lines} >= 8000 THEN 10 ELSE 8 END)"
    return f"CAST(CASE WHEN {lines} < 250 THEN 1 ELSE least({by_time}, {cap}) END AS BIGINT)"


def target_lines(lines: str) -> str:
    return f"CAST(greatest(650, round_even((1000.0::DOUBLE + {lines} / 12.0::DOUBLE) * ({factor(0.92, 1.0, 1.16)})::DOUBLE, 0)) AS BIGINT)"


def min_blocks(lines: str, tokens: str, seconds: str) -> str:
    return f"CAST(CASE WHEN {seconds} >= 1920 OR {lines} >= 1200 OR {tokens} >= 8000 THEN 4 WHEN {seconds} >= 1080 OR {lines} >= 650 OR {tokens} >= 4200 THEN 3 WHEN {seconds} >= 600 OR {lines} >= 350 OR {tokens} >= 2200 THEN 2 ELSE 1 END AS BIGINT)"


def label(index: str) -> str:
    """SQL of a chunk label up to four letters."""
    letter = lambda below, k: f"chr(CAST(65 + (({index} - {below}) // {26**k}) % 26 AS INT))"
    out, below = [], 0
    for n in range(1, 5):
        out.append(f"WHEN {index} < {below + 26**n} THEN " + " || ".join(letter(below, k) for k in range(n - 1, -1, -1)))
        below += 26**n
    return "CASE " + " ".join(out) + " END"


RANGES = rf""",
f AS (SELECT s.work_id, s.doc_id, s.lines, s.estimated_tokens, s.seconds, w.speaker_stage, w.content_mode FROM s JOIN w USING (work_id)),
k AS (SELECT *, {chunk_count("lines", "seconds", "estimated_tokens")} AS chunks FROM f),
z AS (SELECT *, CAST(ceil(lines / chunks) AS BIGINT) AS chunk_size FROM k),
o AS (SELECT *, CAST(greatest(10, least(24, round_even(chunk_size * 0.08::DOUBLE, 0))) AS BIGINT) AS overlap, unnest(range(chunks)) AS i FROM z),
r AS (SELECT *, i * chunk_size + 1 AS extraction_start, CASE WHEN i = chunks - 1 THEN lines ELSE least(lines, (i + 1) * chunk_size) END AS extraction_end, row_number() OVER (PARTITION BY work_id ORDER BY doc_id, i) - 1 AS idx FROM o),
c AS (SELECT *, {label("idx")} AS chunk_id, CASE WHEN idx > 0 THEN greatest(1, extraction_start - overlap) END AS context_start, CASE WHEN idx > 0 THEN greatest(1, extraction_start - 1) END AS context_end FROM r)"""
MODES = "CASE WHEN c <= 1 THEN 'single' WHEN m = 'monologue' AND s > 0 AND s <= 1080 AND c <= 2 THEN 'single' WHEN m = 'monologue' AND c <= 4 AND s <= 2100 THEN 'micro-multi' WHEN c <= 3 THEN 'micro-multi' ELSE 'multi' END"


def words(values: tuple[str, ...], column: str, how: str = "contains") -> str:
    return "(" + " OR ".join(f"{how}({column}, '{v}')" for v in values) + ")"


def counted(values: tuple[str, ...], column: str) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, '{v}') AS BIGINT)" for v in values) + ")"


SQUEEZE = r"trim(regexp_replace({0}, '[\s\p{Z}]+', ' ', 'g'))"


def squeeze(x: str) -> str:
    return SQUEEZE.replace("{0}", x)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def title(x: str) -> str:
    """SQL of a title without unescaping."""
    t = strip(rf"regexp_replace({x}, '<[^>]+>', '', 'g')")
    t = rf"regexp_replace({t}, '^\s*#\s+(.+?)\s*$', '\1')"
    t = rf"regexp_replace({t}, '^(?:\*?\d{{1,2}}:\d{{2}}(?::\d{{2}})?\*?\s+)+', '')"
    t = rf"regexp_replace({t}, '(?i)^(?:\*\*)?speaker\s+\d+(?:\*\*)?\s*:?\s*', '')"
    t = rf"regexp_replace({t}, '__|[`*]', '', 'g')"
    t = rf"regexp_replace({t}, '^[>\-–—•\s:;,.]+', '')"
    return f"trim(substr({squeeze(t)}, 1, 140))"


def is_title(x: str) -> str:
    return rf"(length({x}) >= 4 AND NOT regexp_matches({x}, '(?i)^(?:transcript|notes|summary|audio|video|recording|source|meeting|lecture)$') AND NOT regexp_matches({x}, '(?i)^speaker\s+\d+$') AND NOT regexp_matches({x}, '^[\d\s:._-]+$'))"


def person(x: str) -> str:
    inner = strip(f"regexp_replace({title(x)}, '^@', '')")
    return rf"trim(substr(regexp_replace({squeeze(inner)}, '^[ \-|]+|[ \-|]+$', '', 'g'), 1, 80))"


def statement(x: str) -> str:
    t = squeeze(x)
    for pattern in (r"^\*\*[^*]+\*\*\s*:?\s*", r"^[—–-]\s*", r"\s*\*\([^)]+\)\*\s*$", r"\.+$"):
        t = f"regexp_replace({t}, '{pattern}', '')"
    return f"trim({t})"


TOPIC_TOKENS = r"list_filter(regexp_extract_all(lower({0}), '[a-zа-яё0-9]+'), lambda w: length(w) >= 4 AND w NOT IN ('этого', 'этими', 'почему', 'через', 'когда', 'после', 'теория', 'вопрос', 'совет', 'автора'))"
WORDS = r"len(regexp_extract_all({0}, '[\p{L}\p{M}\p{N}_''-]+'))"
POINTS = (
    LINES
    + r""",
q AS (SELECT source AS work_id, doc_id AS chunk_id, line_no, nullif("""
    + squeeze(r"regexp_extract(text, '^\s*(?:\d+[.)]|[-*])\s+(.+?)\s*$', 1)")
    + ", '') AS bullet, nullif("
    + squeeze("text")
    + r""", '') AS line FROM dl),
h AS (SELECT *, count(bullet) OVER (PARTITION BY work_id, chunk_id) > 0 AS has FROM q),
p AS (SELECT work_id, chunk_id, has, row_number() OVER (PARTITION BY work_id, chunk_id ORDER BY line_no) - 1 AS pos, CASE WHEN has THEN bullet ELSE line END AS point FROM h WHERE CASE WHEN has THEN bullet ELSE line END IS NOT NULL),
pts AS (SELECT work_id, chunk_id, pos, point FROM p WHERE has OR pos < 7)"""
)
TURNS = (
    CONVERSATION_LINES
    + r""",
u0 AS (SELECT doc_id, line_no, 'Speaker ' || n AS speaker, """
    + strip(r"regexp_replace(said, '[ \t]+', ' ', 'g')")
    + r""" AS text FROM cl),
u1 AS (SELECT doc_id, line_no, 'Speaker ' || n AS speaker, """
    + strip("said")
    + r""" AS text FROM cl),
v AS (SELECT *, lag(speaker) OVER (PARTITION BY doc_id ORDER BY line_no) = speaker AND NOT regexp_matches(lag(text) OVER (PARTITION BY doc_id ORDER BY line_no), '[.!?…]$') AS goes_on FROM u1),
x AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM v),
y AS (SELECT doc_id, island, any_value(speaker) AS speaker, string_agg(text, ' ' ORDER BY line_no) AS text FROM x GROUP BY doc_id, island)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS utt_no, speaker, text FROM y WHERE NOT regexp_matches(text, '^[.\s,;:]*$')"""
)
def pad(x: str) -> str:
    """SQL of a number with two digits at least."""
    return f"CASE WHEN {x} < 10 THEN '0' ELSE '' END || CAST({x} AS VARCHAR)"


def pick(k: str, values: tuple[str, ...]) -> str:
    """SQL of one of the values, by a number."""
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[CAST(({k}) % {len(values)} + 1 AS INT)]"


def unquoted(x: str) -> str:
    return f"""regexp_replace({x}, '^[«»"]+|[«»"]+$', '', 'g')"""


def actions() -> str:
    """SQL of candidates, requests, scores and buckets of actions."""
    low = "lower(candidate)"
    first = "lower(regexp_replace(string_split(candidate, ' ')[1], '^[«»\".,:;!?]+|[«»\".,:;!?]+$', '', 'g'))"
    verbs = ", ".join(f"'{v}'" for v in L.IMPERATIVES)
    prefixed = " ".join(f"WHEN contains({low}, '{w}') THEN '{p}' || lower(substr(candidate, 1, 1)) || substr(candidate, 2)" for w, p in L.IMPERATIVE_PREFIXES)
    score = f"2 * {counted(L.STRONG_ACTION, low)} + {counted(L.WEAK_ACTION, low)} - 2 * {counted(L.NO_ACTION, low)} + CAST(contains(candidate, '?') OR contains(candidate, '«') AS BIGINT) - CAST(length(candidate) > 220 AS BIGINT)"
    bucket = f"CASE WHEN score < 2 THEN NULL WHEN {words(L.IMMEDIATE_WORDS, low)} OR {words(L.IMMEDIATE_STARTS, low, 'starts_with')} THEN 'immediate' WHEN {words(L.ONGOING_WORDS, low)} OR {words(L.ONGOING_STARTS, low, 'starts_with')} THEN 'ongoing' ELSE 'month' END"
    return rf"""WITH t AS (SELECT doc_id AS id, {pick("doc_id", ACTION_TEXTS)} || CASE WHEN doc_id % 24 >= 12 THEN ' ' || replace(substr(coalesce(text, ''), 1, 40), chr(10), ' ') ELSE '' END AS text FROM documents), s AS (SELECT id, {statement("text")} AS s FROM t), a AS (SELECT id, s, strpos(s, ':') AS i, {squeeze(unquoted(strip("substr(s, strpos(s, ':') + 1)")))} AS rest FROM s),
c AS (SELECT id, regexp_replace({unquoted(strip(f"CASE WHEN i > 0 AND rest <> '' AND {words(L.ACTION_PREFIX_MARKERS, 'lower(substr(s, 1, i - 1))')} THEN rest ELSE s END"))}, '\.+$', '') AS candidate FROM a),
k AS (SELECT *, {score} AS score FROM c) SELECT id, candidate, CASE WHEN candidate = '' OR {first} IN ({verbs}) THEN candidate {prefixed} ELSE candidate END AS imperative, CAST(score AS BIGINT) AS score, {bucket} AS bucket FROM k"""


SQL: dict[str, str] = {
    "doc_lines_scan": f"WITH {LINES} SELECT doc_id, line_no, text FROM dl",
    "doc_token_estimate": f"WITH {LINES} SELECT doc_id, {TOKENS} AS estimated_tokens FROM dl GROUP BY doc_id",
    "source_file_meta": f"WITH {SOURCE_LINES}, {meta('sl')} SELECT * FROM m",
    "conversation_file_meta": f"WITH {CONVERSATION_LINES}, {meta('cl')} SELECT * FROM m",
    "line_features_count": f"WITH {CONVERSATION_LINES} SELECT doc_id, {NAME} AS speaker_name, count(*) AS lines, count(*) FILTER (regexp_matches(text, {DIALOGUE})) AS dialogue, count(*) FILTER (regexp_matches(text, {CLUE})) AS clues, CAST(sum(len(regexp_extract_all(text, {MARKER}, 1))) AS BIGINT) AS markers FROM cl GROUP BY ALL",
    "drop_repeated_lines": rf"WITH {LINES}, c AS (SELECT doc_id, line_no, {strip("regexp_replace(replace(text, '<unk>', ''), '[ \t]+', ' ', 'g')")} AS text FROM dl), b AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM c) SELECT doc_id, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM b WHERE before IS NULL OR before <> text GROUP BY doc_id",
    "densest_window": rf"""WITH {SOURCE_LINES}, n AS (SELECT doc_id, max(line_no) AS n FROM sl GROUP BY doc_id),
sp AS (SELECT doc_id, n - 150 AS e, CAST(greatest(1, (n - 100 - 40 - 50) // 20) AS BIGINT) AS step FROM n WHERE n - 140 > 50),
w AS (SELECT doc_id, unnest(range(40, e, step)) AS o FROM sp),
g AS (SELECT w.doc_id, w.o, count(*) FILTER (regexp_matches(text, {CLUE})) + 2 * len(list_distinct(flatten(list(regexp_extract_all(text, {MARKER}, 1))))) AS score FROM w JOIN sl ON sl.doc_id = w.doc_id AND line_no > o AND line_no <= o + 50 GROUP BY w.doc_id, w.o)
SELECT doc_id, arg_max(o, score * 1000000 - o) AS "offset", CAST(max(score) AS BIGINT) AS score FROM g GROUP BY doc_id""",
    "clue_context": rf"""WITH {CONVERSATION_LINES}, q AS (SELECT doc_id, line_no AS hit, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS clue_no FROM cl WHERE regexp_matches(text, {CLUE}))
SELECT cl.doc_id, clue_no, line_no, CASE WHEN line_no = hit THEN '>>>' ELSE '   ' END AS mark, {strip("text")} AS text FROM q JOIN cl ON cl.doc_id = q.doc_id AND line_no BETWEEN hit - 2 AND hit + 2 WHERE clue_no <= 15""",
    "prescan_sections": rf"""WITH {SOURCE_LINES}, {CONVERSATION_LINES}, al AS (SELECT doc_id, line_no, text FROM sl UNION ALL SELECT doc_id, line_no, text FROM cl), n AS (SELECT doc_id, max(line_no) AS n FROM al GROUP BY doc_id),
sp AS (SELECT doc_id, n - 150 AS e, CAST(greatest(1, (n - 190) // 20) AS BIGINT) AS step FROM n WHERE n - 140 > 50), w AS (SELECT doc_id, unnest(range(40, e, step)) AS o FROM sp),
g AS (SELECT w.doc_id, w.o, count(*) FILTER (regexp_matches(text, {CLUE})) + 2 * len(list_distinct(flatten(list(regexp_extract_all(text, {MARKER}, 1))))) AS score FROM w JOIN al ON al.doc_id = w.doc_id AND line_no > o AND line_no <= o + 50 GROUP BY w.doc_id, w.o),
b AS (SELECT doc_id, arg_max(o, score * 1000000 - o) AS o FROM g GROUP BY doc_id),
q AS (SELECT doc_id, line_no AS hit, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS clue_no FROM al WHERE regexp_matches(text, {CLUE})),
p AS (SELECT doc_id, 1 AS section, 0 AS part, line_no, length(text) AS k FROM al WHERE line_no <= 40 UNION ALL SELECT al.doc_id, 2, 0, line_no, length(text) FROM al JOIN n USING (doc_id) WHERE n > 140 AND line_no > n - 100 UNION ALL SELECT al.doc_id, 3, 0, line_no, length(text) FROM al JOIN b ON b.doc_id = al.doc_id AND line_no > o AND line_no <= o + 50
  UNION ALL SELECT al.doc_id, 4, clue_no, line_no, 4 + length({strip("text")}) FROM q JOIN al ON al.doc_id = q.doc_id AND line_no BETWEEN hit - 2 AND hit + 2 WHERE clue_no <= 15)
SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(part AS BIGINT) AS part, count(*) AS lines, min(line_no) AS first_line, max(line_no) AS last_line, CAST(sum(k) AS BIGINT) AS chars FROM p GROUP BY ALL""",
    "topic_hint": f"WITH {LINES}, t AS (SELECT doc_id, line_no, {title('text')} AS title FROM dl WHERE line_no <= 80) SELECT doc_id, arg_min(title, line_no) AS topic_hint FROM t WHERE {is_title('title')} GROUP BY doc_id",
    "imperative_actions": actions(),
    "work_totals": f"WITH {SOURCE_LINES}, {meta('sl')} {WORKS} SELECT work_id, files, lines, estimated_tokens, markers, dialogue_cues, dialogue_speakers, intro_cues, duration_seconds, speaker_stage, content_mode FROM w",
    "source_chunk_plan": rf"""WITH {SOURCE_LINES}, {meta('sl')} {WORKS} {RANGES},
ct AS (SELECT c.doc_id, c.chunk_id, {TOKENS} AS tokens, string_agg(text, chr(10) ORDER BY line_no) AS body FROM c JOIN sl ON sl.doc_id = c.doc_id AND line_no BETWEEN extraction_start AND extraction_end GROUP BY ALL),
d AS (SELECT c.*, ct.tokens, ct.body, CASE WHEN seconds > 0 THEN CAST(round_even(seconds * ((extraction_end - extraction_start + 1) / lines), 0) AS BIGINT) ELSE 0 END AS approx FROM c JOIN ct USING (doc_id, chunk_id))
SELECT work_id, doc_id, chunk_id, context_start, context_end, extraction_start, extraction_end, coalesce(context_start, extraction_start) AS read_start, extraction_end AS read_end, chunk_size, overlap, tokens AS estimated_tokens, approx AS approx_duration_seconds,
  {min_blocks("(extraction_end - extraction_start + 1)", "tokens", "approx")} AS min_blocks, {target_lines("lines")} AS target_lines, content_mode, speaker_stage,
  substr(sha256(concat_ws(chr(10), doc_id, speaker_stage, extraction_start, extraction_end, coalesce(CAST(context_start AS VARCHAR), ''), coalesce(CAST(context_end AS VARCHAR), ''), body)), 1, 12) AS chunk_fingerprint FROM d""",
    "chunk_lines": f"WITH {SOURCE_LINES}, {meta('sl')} {WORKS} {RANGES} SELECT c.doc_id, chunk_id, count(*) AS lines, min(line_no) AS first_line, max(line_no) AS last_line, CAST(sum(length(text)) AS BIGINT) AS chars FROM c JOIN sl ON sl.doc_id = c.doc_id AND line_no BETWEEN extraction_start AND extraction_end GROUP BY ALL",
    "chunk_labels": f"SELECT doc_id, {label('doc_id')} AS label FROM documents",
    "work_fingerprint": f"WITH {SOURCE_LINES}, {meta('sl')} SELECT 'corpus' AS work_id, substr(sha256(string_agg(concat_ws('|', doc_id, lines, bytes, 0), chr(10) ORDER BY doc_id)), 1, 12) AS fingerprint FROM m",
    "conversation_modes": f"WITH {CONVERSATION_LINES}, {meta('cl')} {WORKS.replace(chr(39) + 'corpus' + chr(39), 'doc_id')} SELECT work_id, lines, markers, dialogue_cues, dialogue_speakers, speaker_stage, content_mode, 'single' AS execution_mode, CAST(CASE WHEN speaker_stage = 'skip' THEN 40 ELSE 200 END AS BIGINT) AS prescan_limit, lines < 250 AS quick FROM w",
    "note_contract_tiers": rf"""WITH o AS (SELECT o_orderkey, o_orderkey * 37 % 11000 AS s, (['monologue', 'conversation', 'workshop'])[CAST(o_orderkey % 3 + 1 AS INT)] AS m, o_orderkey % 12 + 1 AS c FROM orders),
b AS (SELECT *, s / 60.0 AS mi, CASE WHEN m = 'monologue' THEN CASE WHEN s > 0 AND s <= 1080 THEN [5, 6] WHEN s > 0 AND s <= 2100 THEN [6, 8] WHEN s >= 9000 THEN [12, 16] WHEN s >= 5400 THEN [10, 14] WHEN c <= 3 THEN [7, 9] ELSE [8, 10] END
  WHEN m = 'conversation' THEN CASE WHEN s > 0 AND s <= 1800 THEN [6, 8] WHEN s >= 9000 THEN [12, 16] WHEN s >= 5400 THEN [10, 14] ELSE [7, 10] END
  ELSE CASE WHEN s >= 9000 THEN [13, 18] WHEN s >= 5400 THEN [11, 15] WHEN s > 0 AND s <= 2100 THEN [7, 9] ELSE [8, 12] END END AS t,
  CASE WHEN s >= 9000 THEN CASE m WHEN 'monologue' THEN [3, 0.25] WHEN 'workshop' THEN [5, 0.35] ELSE [4, 0.3] END WHEN s >= 7200 THEN CASE m WHEN 'monologue' THEN [2, 0.2] WHEN 'workshop' THEN [4, 0.3] ELSE [3, 0.25] END END AS k FROM o)
SELECT o_orderkey, CAST(t[1] AS BIGINT) AS tldr_min, CAST(t[2] AS BIGINT) AS tldr_max, CAST(CASE WHEN s >= 5400 THEN 7 WHEN s >= 3600 THEN 6 ELSE 5 END AS BIGINT) AS theses_min,
  CAST(CASE WHEN s >= 7200 THEN CASE WHEN m = 'workshop' THEN 11 ELSE 10 END WHEN s >= 5400 THEN CASE WHEN m = 'workshop' THEN 10 ELSE 9 END WHEN s >= 3600 THEN 9 ELSE 8 END AS BIGINT) AS theses_max,
  CASE WHEN s >= 5400 THEN 'expected' WHEN s >= 3600 THEN 'preferred' ELSE 'optional' END AS meaning_section, CASE WHEN s >= 7200 THEN 'deep_longform' ELSE 'standard' END AS detail_profile,
  CAST(CASE WHEN s >= 9000 THEN 24 WHEN s >= 5400 THEN 20 WHEN s >= 2700 THEN 15 WHEN s >= 1200 THEN 11 ELSE 0 END AS BIGINT) AS words_per_min,
  CAST(CASE WHEN s >= 9000 THEN greatest(5, ceil(c * 0.8::DOUBLE)) WHEN s >= 7200 THEN greatest(4, ceil(c * 0.75::DOUBLE)) ELSE 0 END AS BIGINT) AS min_meaning_blocks, CAST(CASE WHEN s >= 7200 THEN greatest(k[1], ceil(c * k[2]::DOUBLE)) ELSE 0 END AS BIGINT) AS min_case_blocks,
  CASE m WHEN 'monologue' THEN 'лекция' WHEN 'conversation' THEN 'интервью' ELSE 'воркшоп' END AS format_label, {MODES} AS execution_mode FROM b""",
    "chunk_counts": rf"""WITH o AS (SELECT o_orderkey, (['required', 'optional', 'skip'])[CAST(o_orderkey % 3 + 1 AS INT)] AS speaker_stage, (['monologue', 'conversation', 'workshop'])[CAST(o_orderkey // 3 % 3 + 1 AS INT)] AS content_mode,
  o_orderkey * 7 % 15000 AS n, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 31 % 9000 ELSE 0 END AS s, o_orderkey * 13 % 40000 AS k FROM orders)
SELECT o_orderkey, {chunk_count("n", "s", "k")} AS chunks, {min_blocks("n", "k", "s")} AS min_blocks, {target_lines("n")} AS target_lines FROM o""",
    "conversation_speakers": "SELECT DISTINCT conv_id, role, 'Speaker ' || dense_rank() OVER (PARTITION BY conv_id ORDER BY role) AS speaker FROM conversations",
    "merged_turns": f"WITH {TURNS}",
    "merged_filled_turns": f"WITH {TURNS}",
    "renamed_speakers": rf"""WITH {CONVERSATION_LINES}, nl AS (SELECT doc_id, conv_id, line_no, text || CASE WHEN line_no % 2 = 0 THEN ' (Speaker 12, Speaker 1)' ELSE '' END AS text FROM cl), y AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(role = 'system')),
t AS (SELECT nl.doc_id AS work_id, line_no, text, CASE WHEN y.conv_id IS NULL THEN text ELSE regexp_replace(regexp_replace(text, 'Speaker 12\b', 'Speaker 1 bis', 'g'), 'Speaker 1\b', 'Иван $1', 'g') END AS new FROM nl LEFT JOIN y USING (conv_id)) SELECT work_id, line_no, new AS text, new <> text AS modified FROM t""",
    "rename_totals": rf"""WITH {CONVERSATION_LINES}, y AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(role = 'system'))
SELECT doc_id AS work_id, count(*) FILTER (y.conv_id IS NOT NULL AND (line_no % 2 = 0 OR regexp_matches(text, 'Speaker 1\b'))) AS modified, CAST(max(CASE WHEN y.conv_id IS NULL THEN 0 ELSE 2 END) AS BIGINT) AS mappings, bool_and(y.conv_id IS NULL) AS skipped FROM cl LEFT JOIN y USING (conv_id) GROUP BY doc_id""",
    "timed_modes": rf"""WITH {CONVERSATION_LINES}, tl AS (SELECT doc_id, line_no, text || CASE WHEN conv_id % 5 > 0 THEN ' *' || ({pad("conv_id % 60")}) || ':' || ({pad("line_no")}) || '*' ELSE '' END AS text FROM cl), {meta('tl')} {WORKS.replace(chr(39) + 'corpus' + chr(39), 'CAST(CAST(doc_id AS BIGINT) // 4 AS VARCHAR)')}
SELECT s.work_id, s.doc_id, w.files, w.duration_seconds, CAST(s.seconds AS BIGINT) AS seconds, w.speaker_stage, w.content_mode FROM s JOIN w USING (work_id)""",
    "transcript_markdown": rf"""WITH t AS (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations WHERE text <> '') SELECT CAST(conv_id AS VARCHAR) AS doc_id, regexp_replace(string_agg('*' || ({pad("turn * 10 // 60")}) || ':' || ({pad("turn * 10 % 60")}) || '* ' || text, chr(10) ORDER BY turn), '\s+$', '') || chr(10) AS text FROM t GROUP BY conv_id""",
    "folded_segments": rf"""WITH e AS (SELECT *, event_id % 6000 AS s, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e)
SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(island AS BIGINT) AS utt_no, any_value(event_type) AS speaker, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY event_id) AS text, ({pad("arg_min(s, event_id) // 60")}) || ':' || ({pad("arg_min(s, event_id) % 60")}) AS ts FROM i GROUP BY user_id, island""",
    "best_subtitles": f"""WITH {LINES}, t AS (SELECT doc_id, source, count(*) AS cues, CAST(sum(length(text)) AS BIGINT) AS chars FROM dl GROUP BY ALL), f AS (SELECT t.*, d.lang, t.doc_id || '.' || d.lang || '.vtt' AS name FROM t JOIN documents d USING (doc_id) WHERE CASE WHEN t.doc_id % 2 = 0 THEN cues >= 2 AND chars >= 20 ELSE cues >= 20 AND chars >= 400 END),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'ru' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, chars DESC, name) AS n FROM f) SELECT source AS work_id, doc_id, name, lang AS language, chars FROM r WHERE n = 1""",
    "numbered_blocks": f"WITH e AS (SELECT user_id AS work_id, event_id, {label('(event_id % 60)')} AS chunk_id FROM events) SELECT work_id, chunk_id, event_id AS block_no, row_number() OVER (PARTITION BY work_id ORDER BY length(chunk_id), chunk_id, event_id) AS number FROM e",
    "summary_points": f"WITH {POINTS} SELECT * FROM pts",
    "tldr_round_robin": rf"""WITH {POINTS}, f AS (SELECT *, {strip("point")} AS pt, lower({squeeze("point")}) AS key, row_number() OVER (PARTITION BY work_id, lower({squeeze("point")}) ORDER BY pos, chunk_id) AS n FROM pts),
r AS (SELECT *, dense_rank() OVER (PARTITION BY work_id ORDER BY pos) - 1 AS round FROM f WHERE n = 1), g AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY pos, chunk_id) AS rank FROM r WHERE round = pos),
t AS (SELECT work_id, count(DISTINCT chunk_id) AS files FROM pts GROUP BY work_id) SELECT work_id, rank, pt AS point FROM g JOIN t USING (work_id) WHERE rank <= CASE WHEN files <= 1 THEN 5 WHEN files = 2 THEN 7 WHEN files = 3 THEN 8 WHEN files = 4 THEN 9 ELSE 10 END""",
    "topic_top8": rf"""WITH t AS (SELECT source AS work_id, doc_id, regexp_extract(text, '^([^ \n]+)', 1) AS topic FROM documents WHERE text IS NOT NULL), c AS (SELECT work_id, topic, count(*) AS n, min(doc_id) AS f FROM t WHERE {squeeze("topic")} <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY n DESC, f) AS rank FROM c) SELECT work_id, topic, n, rank FROM r WHERE rank <= 8""",
    "topic_best_match": rf"""WITH {LINES}, b AS (SELECT DISTINCT text AS topic, unnest(list_distinct({TOPIC_TOKENS.replace("{0}", "text")})) AS tok FROM benchmark), l AS (SELECT (doc_id, line_no) AS pos, text AS line, unnest(list_distinct({TOPIC_TOKENS.replace("{0}", "text")})) AS tok FROM dl),
s AS (SELECT topic, pos, line, count(*) AS score FROM b JOIN l USING (tok) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, pos) AS n FROM s) SELECT 'corpus' AS work_id, topic, line, score FROM r WHERE n = 1""",
    "people_mentions": rf"""WITH t AS (SELECT doc_id, regexp_replace(text, '([\p{{L}}\p{{M}}\p{{N}}_]+)', '‹\1›', 'g') AS text FROM documents),
p AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:‹[A-Z][a-z]+›(?:\s+‹[A-Z][a-z]+›){{1,2}}|‹[А-ЯЁ][а-яё]+›(?:\s+‹[А-ЯЁ][а-яё]+›){{1,2}})', 0)) AS name FROM t) SELECT DISTINCT doc_id, regexp_replace(translate(name, '‹›', ''), '\s+', ' ', 'g') AS name FROM p""",
    "time_formats": rf"""WITH e AS (SELECT event_id, event_id * 7 % 20000 AS s FROM events) SELECT event_id, ({pad("s // 60")}) || ':' || ({pad("s % 60")}) AS mmss, CASE WHEN s >= 3600 THEN ({pad("s // 3600")}) || ':' ELSE '' END || ({pad("s % 3600 // 60")}) || ':' || ({pad("s % 60")}) AS hhmmss, s AS seconds, s AS vtt_seconds FROM e""",
    "parsed_times": rf"""WITH t AS (SELECT event_id, {pick("event_id", TIMES)} AS text FROM events), p AS (SELECT event_id, text, string_split(text, ':') AS p FROM t)
SELECT event_id, text, CAST(coalesce(CASE len(p) WHEN 3 THEN TRY_CAST(p[1] AS INT) * 3600 + TRY_CAST(CASE WHEN contains(p[2], '.') THEN NULL ELSE p[2] END AS INT) * 60 + TRY_CAST(CASE WHEN contains(p[3], '.') THEN NULL ELSE p[3] END AS INT) WHEN 2 THEN TRY_CAST(p[1] AS INT) * 60 + TRY_CAST(CASE WHEN contains(p[2], '.') THEN NULL ELSE p[2] END AS INT) END, 0) AS BIGINT) AS seconds,
  CAST(1000 * coalesce(CASE len(p) WHEN 1 THEN TRY_CAST(p[1] AS DOUBLE) WHEN 2 THEN TRY_CAST(p[1] AS INT) * 60 + TRY_CAST(p[2] AS DOUBLE) ELSE TRY_CAST(p[1] AS INT) * 3600 + TRY_CAST(p[2] AS INT) * 60 + TRY_CAST(p[3] AS DOUBLE) END, 0) AS BIGINT) AS vtt_ms FROM p""",
    "video_ids": rf"""WITH u AS (SELECT page_id, {pick("page_id", URLS)} || CASE WHEN page_id % 20 >= 10 THEN '&p=' || page_id ELSE '' END AS url FROM pages) SELECT page_id, url, nullif(regexp_extract(url, '(?:youtube\.com/watch\?(?:.*?&)?v=|youtu\.be/|youtube\.com/shorts/|youtube\.com/live/|youtube\.com/embed/)([A-Za-z0-9_-]{{11}})', 1), '') AS video_id,
  CASE WHEN contains(url, 'youtube.com/') OR contains(url, 'youtu.be/') THEN 'youtube' WHEN lower(regexp_extract(url, '(\.[^./]*)$', 1)) IN ('.m4a', '.mp3', '.wav', '.ogg', '.opus', '.webm', '.mp4', '.mkv', '.mov', '.avi') THEN 'audio' ELSE 'local' END AS route FROM u""",
    "page_title_clean": rf"""WITH t AS (SELECT page_id, {title("(regexp_replace(regexp_replace(coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), '&quot;?', chr(34), 'g'), '&amp;?', '&', 'g') || CASE WHEN page_id % 2 = 0 THEN ' & é<' ELSE '' END)")} AS title FROM pages) SELECT page_id, title, {is_title("title")} AS informative FROM t""",
    "page_routes": "SELECT page_id, 'local' AS route, trim(url) AS reference, 'url:' || sha1(trim(url)) AS note_id FROM pages",
    "person_hints": rf"""WITH t AS (SELECT doc_id, {pick("doc_id", NAMES)} || CASE WHEN doc_id % 36 >= 18 THEN ' ' || coalesce(lang, '?') || doc_id ELSE '' END AS name FROM documents), s AS (SELECT doc_id, name, regexp_replace(regexp_replace(regexp_replace({strip("name")}, '^[A-Za-z0-9_-]{{11}}-', ''), '(?i)^\d{{4}}-\d{{2}}-\d{{2}}-[a-f0-9]{{6,}}$', ''), '(?i)-[a-f0-9]{{8,}}$', '') AS p FROM t),
h AS (SELECT doc_id, name, regexp_replace({squeeze("translate(p, '_-', '  ')")}, '^[ .\-_]+|[ .\-_]+$', '', 'g') AS p FROM s)
SELECT doc_id, name, {person("name")} AS person, length({strip("name")}) >= 2 AND NOT regexp_matches({strip("name")}, '(?i)^speaker\s+\d+$') AND NOT regexp_matches({strip("name")}, '^[\d\s:._/\-]+$') AND lower({strip("name")}) NOT IN ('author', 'creator', 'uploader', 'channel') AS is_person,
  {squeeze("name")} IN ('', '—', '-', '–') OR lower({squeeze("name")}) IN ('unknown', 'speaker', 'author', 'creator', 'uploader') OR regexp_matches({squeeze("name")}, '(?i)^speaker\s+\d+$') AS placeholder,
  {title("(upper(substr(p, 1, 1)) || substr(p, 2))")} AS path_title, array_to_string(list_filter(list_transform(string_split_regex(name, '[;|,]\s*'), lambda x: trim(x)), lambda x: x NOT IN ('', '—', '-', '–')), '|') AS parts FROM h""",
    "topic_tokens": rf"""SELECT item_id, CAST(len({TOPIC_TOKENS.replace("{0}", "text")}) AS BIGINT) AS n_tokens, array_to_string({TOPIC_TOKENS.replace("{0}", "text")}, ' ') AS tokens, CASE WHEN length({squeeze("text")}) <= 140 THEN {squeeze("text")} ELSE rtrim(substr({squeeze("text")}, 1, 139)) || '…' END AS short, CAST({WORDS.replace("{0}", "text")} AS BIGINT) AS words FROM benchmark""",
    "text_hashes": "SELECT doc_id, substr(sha256(text), 1, 12) AS short_hash, sha1(text) AS sha1 FROM documents",
    "duplicate_titles": rf"""WITH {LINES}, t AS (SELECT source AS work_id, lower({squeeze("text")}) AS title FROM dl WHERE line_no = 1) SELECT work_id, title FROM t WHERE title <> '' GROUP BY ALL HAVING count(*) > 1""",
    "actionability": "SELECT d.source AS work_id, count(*) AS items, count(*) FILTER (quality = 1) AS verbish_items, CAST(floor(round(count(*) FILTER (quality = 1) / count(*), 2) * 100 + 0.5) AS BIGINT) AS percent, round(count(*) FILTER (quality = 1) / count(*), 2) >= 0.6 AS ok FROM documents d JOIN labels USING (doc_id) GROUP BY d.source",
    "note_density": rf"""WITH {LINES}, a AS (SELECT source, CAST(sum({WORDS.replace("{0}", "text")}) AS BIGINT) AS words, count(DISTINCT doc_id) AS blocks FROM dl GROUP BY source), b AS (SELECT *, blocks * 100 AS s, blocks * 100 / 60 AS mi FROM a)
SELECT source, words, blocks, CAST(floor(round(blocks / mi * 10, 2) * 100 + 0.5) AS BIGINT) AS per_10min_x100, round(blocks / mi * 10, 2) >= CASE WHEN mi >= 150 THEN 0.85 WHEN mi >= 90 THEN 0.75 WHEN mi >= 45 THEN 0.6 WHEN mi >= 20 THEN 0.5 ELSE 0 END AND round(words / mi, 2) >= CASE WHEN mi >= 150 THEN 24 WHEN mi >= 90 THEN 20 WHEN mi >= 45 THEN 15 WHEN mi >= 20 THEN 11 ELSE 0 END AS ok FROM b""",
    "header_contract": "SELECT doc_id AS work_id, doc_id % 2 > 0 AND doc_id % 3 > 0 AND doc_id % 4 > 0 AND doc_id % 5 > 0 AND doc_id % 6 > 0 AND doc_id % 7 > 0 AS header_complete, concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'Автор' END, CASE WHEN doc_id % 3 = 0 THEN 'Формат' END, CASE WHEN doc_id % 4 = 0 THEN 'Тема' END, CASE WHEN doc_id % 5 = 0 THEN 'Длительность' END, CASE WHEN doc_id % 6 = 0 THEN 'Источник' END, CASE WHEN doc_id % 7 = 0 THEN 'Главная рамка автора' END) AS missing, CASE WHEN doc_id % 3 = 0 THEN 'Speaker N,unknown' ELSE '' END AS hits FROM documents",
    "coverage_gaps": "WITH e AS (SELECT user_id AS work_id, event_id AS row_no, CAST(floor(epoch(ts)) AS BIGINT) AS start_s, CASE WHEN event_id % 5 > 0 THEN CAST(floor(epoch(ts)) AS BIGINT) + 60 END AS end_s FROM events), g AS (SELECT *, start_s - last_value(end_s IGNORE NULLS) OVER (PARTITION BY work_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_s FROM e) SELECT * FROM g WHERE gap_s > 300",
    "boundary_duplicates": "WITH e AS (SELECT user_id AS work_id, event_id // 3 AS chunk_id, event_id AS block_no, event_type AS topic, lag(event_type) OVER w AS t, lag(event_id // 3) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id // 3, event_id)) SELECT work_id, chunk_id, block_no, topic FROM e WHERE t = topic AND c <> chunk_id",
    "shallow_blocks": f"WITH {LINES}, n AS (SELECT d.doc_id, count(dl.line_no) FILTER (dl.text <> '') AS theses FROM documents d LEFT JOIN dl USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id) SELECT doc_id, theses FROM n WHERE theses < 6",
    "populated_sections": rf"""WITH {LINES}, a AS (SELECT doc_id AS work_id, line_no, line_no % 3 = 1 AS h, CASE WHEN line_no % 2 = 0 THEN 1 ELSE 0 END AS k, CASE WHEN doc_id % 4 = 0 THEN '' ELSE {strip("text")} END AS t FROM dl), s AS (SELECT *, sum(CAST(h AS INT)) OVER (PARTITION BY work_id ORDER BY line_no) AS sec FROM a),
g AS (SELECT work_id, sec, max(k) FILTER (h) AS k, count(*) FILTER (NOT h AND t <> '') AS filled FROM s GROUP BY ALL) SELECT work_id, count(*) FILTER (k = 0) AS meaning_blocks, count(*) FILTER (k = 1) AS case_blocks FROM g WHERE filled > 0 GROUP BY work_id""",
    "event_latest_state": "SELECT user_id, arg_max(event_id, (epoch_us(ts), event_id)) AS event_id, arg_max(event_type, (epoch_us(ts), event_id)) AS event_type, max(epoch_us(ts)) AS ts_us FROM events GROUP BY user_id",
    "event_change_flags": """WITH r AS (SELECT user_id AS note_id, event_id AS run_id, event_type AS a, event_id % 3 AS b, event_id % 2 AS c, CASE WHEN event_id % 4 > 0 THEN event_type END AS q, row_number() OVER w = 1 AS first_run, lag(event_type) OVER w AS a0, lag(event_id % 3) OVER w AS b0, lag(event_id % 2) OVER w AS c0, lag(CASE WHEN event_id % 4 > 0 THEN event_type END) OVER w AS q0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)),
f AS (SELECT note_id, run_id, first_run, CASE WHEN first_run THEN true ELSE a IS DISTINCT FROM a0 END AS input_changed, CASE WHEN first_run THEN true ELSE b IS DISTINCT FROM b0 OR c IS DISTINCT FROM c0 END AS output_changed, CASE WHEN first_run THEN q IS NOT NULL ELSE q IS DISTINCT FROM q0 END AS quality_changed, false AS delivery_changed FROM r)
SELECT *, NOT first_run AND NOT (input_changed OR output_changed OR quality_changed) AS only_resume FROM f""",
    "event_stage_rollup": """WITH e AS (SELECT user_id AS work_id, CASE WHEN event_id % 11 = 0 THEN 'stale' WHEN user_id % 3 = 0 THEN 'ready' ELSE (['ready', 'partial', 'missing'])[CAST(event_id % 3 + 1 AS INT)] END AS s FROM events)
SELECT work_id, CASE WHEN bool_and(s = 'ready') THEN 'ready' WHEN bool_or(s = 'stale') THEN 'stale' WHEN bool_or(s IN ('ready', 'partial')) THEN 'partial' ELSE 'missing' END AS extraction, count(*) AS planned_chunks, count(*) FILTER (s = 'ready') AS ready_chunks, count(*) FILTER (s = 'partial') AS partial_chunks, count(*) FILTER (s = 'missing') AS missing_chunks, count(*) FILTER (s = 'stale') AS stale_chunks FROM e GROUP BY work_id""",
    "planned_vs_observed": """WITH p AS (SELECT doc_id AS chunk_id, true AS planned FROM documents), o AS (SELECT doc_id * 2 AS chunk_id, quality AS b, toxic = 1 AS m, true AS observed FROM labels), j AS (SELECT chunk_id, coalesce(planned, false) AS planned, coalesce(observed, false) AS observed, coalesce(b, 0) > 0 AS b, coalesce(m, false) AS m FROM p FULL JOIN o USING (chunk_id))
SELECT 'corpus' AS work_id, chunk_id, planned, observed, CASE WHEN NOT planned THEN CASE WHEN b OR m THEN 'stale' ELSE 'missing' END WHEN b AND m THEN 'ready' WHEN b OR m THEN 'partial' ELSE 'missing' END AS status FROM j""",
    "pending_docs": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "next_actions": """WITH c AS (SELECT c_custkey, (['ready', 'partial', 'missing', 'stale'])[CAST(c_custkey % 4 + 1 AS INT)] AS e, (['skip', 'required', 'optional'])[CAST(c_custkey // 4 % 3 + 1 AS INT)] AS h, c_custkey % 2 = 0 AS hs, c_custkey % 5 > 1 AS ht, c_custkey % 7 > 2 AS hh, (['f', 'g', ''])[CAST(c_custkey // 3 % 3 + 1 AS INT)] AS tf, (['missing', 'ready'])[CAST(c_custkey // 5 % 2 + 1 AS INT)] AS stt FROM customer),
t AS (SELECT *, CASE WHEN h = 'skip' THEN 'skipped' WHEN hs THEN 'ready' ELSE 'missing' END AS speaker, CASE WHEN ht THEN CASE WHEN e <> 'ready' OR tf = 'g' THEN 'stale' ELSE 'ready' END ELSE stt END AS tldr FROM c),
a AS (SELECT *, CASE WHEN hh THEN CASE WHEN e <> 'ready' OR (ht AND tldr <> 'ready') THEN 'stale' ELSE 'ready' END ELSE 'missing' END AS assemble FROM t)
SELECT c_custkey, speaker, tldr, assemble, CASE WHEN h = 'required' AND speaker NOT IN ('ready', 'skipped') THEN 'speaker-identification' WHEN e <> 'ready' THEN 'extract-chunks' WHEN tldr <> 'ready' THEN 'generate-tldr' WHEN assemble <> 'ready' THEN 'assemble' ELSE 'done' END AS next_action FROM a""",
    "stage_metrics": "SELECT event_type AS stage, count(*) AS events, CAST(sum(event_id % 1000) AS BIGINT) AS total_ms, max(event_id % 1000) AS longest_ms FROM events GROUP BY event_type",
    "run_ledger": """WITH s AS (SELECT event_id // 2 AS r, user_id, ts FROM events WHERE event_id % 2 = 0), f AS (SELECT event_id // 2 AS r, ts AS t FROM events WHERE event_id % 2 = 1 AND event_id % 20 <> 1)
SELECT CAST(s.r AS VARCHAR) AS run_id, CAST(user_id AS VARCHAR) AS note_id, CASE WHEN t IS NULL THEN 'failed' ELSE 'assembled' END AS status FROM s LEFT JOIN f ON f.r = s.r AND t >= ts AND t <= ts + INTERVAL 6 HOURS""",
    "batch_index": """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS f, o_orderkey % 9 > 0 AS ok, CASE WHEN o_orderkey % 10 = 7 THEN 'Unknown' ELSE 'A&amp;B &lt;' || o_orderkey || '&gt;' END AS t FROM orders),
i AS (SELECT f, ok, CASE WHEN f LIKE '%3' THEN '<li>' || t || ' <span class=''meta''>(no HTML)</span></li>' ELSE '<li><a href="' || f || '.html">' || t || '</a></li>' END AS item FROM o)
SELECT count(*) AS total, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, sha256('<ol>' || string_agg(item, '' ORDER BY f) FILTER (ok) || '</ol>') AS html FROM i""",
    "already_delivered": """WITH n AS (SELECT doc_id, source AS title, CAST(doc_id AS VARCHAR) AS path, 'c' AS chat, sha256(text) AS h FROM documents), d AS (SELECT source AS title, CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 4 = 0 THEN 'c' ELSE 'other' END AS chat, CASE WHEN doc_id % 3 > 0 THEN sha256(text) WHEN doc_id % 5 = 0 THEN 'x' END AS h, doc_id % 2 = 0 AS success FROM documents)
SELECT doc_id, path FROM n WHERE EXISTS (SELECT 1 FROM d WHERE d.success AND trim(d.title) = trim(n.title) AND d.path = n.path AND (coalesce(d.chat, '') = '' OR d.chat = n.chat) AND (coalesce(d.h, '') = '' OR d.h = n.h))""",
}
