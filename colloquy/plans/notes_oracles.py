"""DuckDB SQL of the queries over notes and the state of their works."""

from __future__ import annotations

from colloquy.functions import lexicons as L
from colloquy.plans.base_oracles import LINES, MODES, TOPIC_TOKENS, WORDS, counted, is_title, label, person, squeeze, statement, strip, title, unquoted, words
from colloquy.plans.fixtures import ACTION_TEXTS
from colloquy.plans.landed_oracles import is_person, pick


def listed(*parts: str) -> str:
    """SQL of a list of texts without nulls."""
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


def when(test: str, text: str) -> str:
    return f"CASE WHEN {test} THEN {text} END"


def rows(parts: str, more: str, table: str = "documents") -> str:
    """SQL of numbered rows of a list of texts, from 0."""
    return f"SELECT {more}, CAST(unnest(range(len(parts))) AS BIGINT) AS line_no, unnest(parts) AS text FROM (SELECT *, {parts} AS parts FROM {table})"


LABELS = [when(f"doc_id % {i + 2} > 0", f"'**{x}:** y'") for i, x in enumerate(L.HEADER_LABELS)]
NOTE_PARTS = listed(
    when("doc_id % 11 > 0", "'# T'"), when("doc_id % 13 > 0", "'> abstract'"), *LABELS, when("doc_id % 7 > 0", f"'## {L.AUTHOR_FRAME}'"), when("doc_id % 9 = 0", "'Speaker 4 said unknown'"), when("doc_id % 10 = 0", "'- **—** x'"),
    "'### Кейс: Title ' || doc_id % 3", when("doc_id % 4 > 0", "'case text'"), "'### Кейс:  title ' || doc_id % 2", "'more'", "'### Смысл блока:'", when("doc_id % 3 > 0", "'means'"), "'### Действия'", "'- [ ] Проверь всё'", when("doc_id % 2 = 0", "'- [x] страница'"), when("doc_id % 5 = 0", "'- [ ] Не бойся'"),
    "replace(coalesce(text, ''), chr(10), ' ')", when("doc_id % 3 = 0", "'> quote'"),
)
NOTES = f"WITH n AS ({rows(NOTE_PARTS, 'doc_id AS work_id')})"
BOUNDS = """CASE WHEN m = 'monologue' THEN CASE WHEN s > 0 AND s <= 1080 THEN [5, 6] WHEN s > 0 AND s <= 2100 THEN [6, 8] WHEN s >= 9000 THEN [12, 16] WHEN s >= 5400 THEN [10, 14] WHEN c <= 3 THEN [7, 9] ELSE [8, 10] END
  WHEN m = 'conversation' THEN CASE WHEN s > 0 AND s <= 1800 THEN [6, 8] WHEN s >= 9000 THEN [12, 16] WHEN s >= 5400 THEN [10, 14] ELSE [7, 10] END
  ELSE CASE WHEN s >= 9000 THEN [13, 18] WHEN s >= 5400 THEN [11, 15] WHEN s > 0 AND s <= 2100 THEN [7, 9] ELSE [8, 12] END END"""
CASES = "CASE WHEN s >= 9000 THEN CASE m WHEN 'monologue' THEN [3, 0.25] WHEN 'workshop' THEN [5, 0.35] ELSE [4, 0.3] END WHEN s >= 7200 THEN CASE m WHEN 'monologue' THEN [2, 0.2] WHEN 'workshop' THEN [4, 0.3] ELSE [3, 0.25] END END"
WORKS = f"w AS (SELECT doc_id AS work_id, doc_id * 37 % 11000 AS s, {pick('doc_id', 'monologue', 'conversation', 'workshop')} AS m, {pick('doc_id // 2', 'single', 'micro-multi', 'multi')} AS x, doc_id % 12 + 1 AS c, doc_id % 25 AS b, doc_id % 15 AS tc, {pick('doc_id', '@Ann Lee', 'creator', None)} AS author FROM documents)"
DENSE = "CASE WHEN s <= 0 THEN true ELSE round(b / (s / 60.0::DOUBLE) * 10, 2) >= CASE WHEN s >= 9000 THEN 0.85 WHEN s >= 5400 THEN 0.75 WHEN s >= 2700 THEN 0.6 WHEN s >= 1200 THEN 0.5 ELSE 0 END AND round(wc / (s / 60.0::DOUBLE), 2) >= CASE WHEN s >= 9000 THEN 24 WHEN s >= 5400 THEN 20 WHEN s >= 2700 THEN 15 WHEN s >= 1200 THEN 11 ELSE 0 END END"
FIELDS = ", ".join(f"CASE WHEN NOT bool_or(regexp_matches(text, '^\\*\\*{x}:\\*\\*\\s+\\S')) THEN '{x}' END" for x in L.HEADER_LABELS)
VERBS = "(?i)^(?:" + "|".join(v for v in L.IMPERATIVES if v != "не") + r"|не(?:[^\p{L}\p{N}_]|$))"
QUALITY = rf"""{NOTES}, {WORKS}, h AS (SELECT work_id, CAST(sum({WORDS.replace("{0}", "text")}) AS BIGINT) AS wc, list_filter([{FIELDS}, CASE WHEN NOT bool_or(regexp_matches(text, '^##\s+{L.AUTHOR_FRAME}\s*$')) THEN '{L.AUTHOR_FRAME}' END], lambda x: x IS NOT NULL) AS missing,
  bool_or(regexp_matches(text, '^\s*#\s+\S')) AND bool_or(regexp_matches(text, '^\s*>\s+\S')) AS top, list_filter([CASE WHEN bool_or(regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])Speaker\s+\d+($|[^\p{{L}}\p{{N}}_])')) THEN 'Speaker N' END, CASE WHEN bool_or(regexp_matches(text, '^\s*-\s+\*\*[—-]\*\*')) THEN '—' END, CASE WHEN bool_or(regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])unknown($|[^\p{{L}}\p{{N}}_])')) THEN 'unknown' END], lambda x: x IS NOT NULL) AS hits,
  count(*) FILTER (regexp_matches(text, '^\s*-\s+\[[ xX]\]\s+')) AS items, count(*) FILTER (regexp_matches(regexp_extract(text, '^\s*-\s+\[[ xX]\]\s+(.+?)\s*$', 1), '{VERBS}')) AS verbs FROM n GROUP BY work_id),
d0 AS (SELECT work_id, line_no, lower({squeeze(r"regexp_extract(text, '^###\s+Кейс:\s*(.+?)\s*$', 1)")}) AS title FROM n), d1 AS (SELECT *, row_number() OVER (PARTITION BY work_id, title ORDER BY line_no) AS k FROM d0 WHERE title <> ''), d AS (SELECT work_id, list(title ORDER BY line_no) AS dup FROM d1 WHERE k = 2 GROUP BY work_id),
p0 AS (SELECT work_id, line_no, {strip("text")} AS t, regexp_matches({strip("text")}, '^###\s+') AS h FROM n), p1 AS (SELECT *, sum(CAST(h AS INT)) OVER (PARTITION BY work_id ORDER BY line_no) AS sec FROM p0), p2 AS (SELECT work_id, sec, max(t) FILTER (h) AS head, count(*) FILTER (NOT h AND t <> '') AS filled FROM p1 WHERE sec > 0 GROUP BY ALL),
p AS (SELECT work_id, count(*) FILTER (regexp_matches(head, '^###\s+Смысл блока:\s*$')) AS meaning, count(*) FILTER (regexp_matches(head, '^###\s+Кейс:\s*(.+?)\s*$')) AS cases FROM p2 WHERE filled > 0 GROUP BY work_id),
q AS (SELECT w.*, h.* EXCLUDE (work_id), top AND len(missing) = 0 AS complete, coalesce(dup, []) AS dups, coalesce(meaning, 0) AS meaning, coalesce(cases, 0) AS cases, {BOUNDS} AS t, {CASES} AS k, CASE WHEN items = 0 THEN true ELSE round(verbs / items, 2) >= 0.6 END AS actions_ok, {DENSE} AS dense FROM w JOIN h USING (work_id) LEFT JOIN d USING (work_id) LEFT JOIN p USING (work_id)),
r AS (SELECT *, tc >= t[1] AND tc <= t[2] AS tldr_ok, s < 7200 OR (meaning >= CASE WHEN s >= 9000 THEN greatest(5, ceil(b * 0.8::DOUBLE)) ELSE greatest(4, ceil(b * 0.75::DOUBLE)) END AND cases >= greatest(k[1], ceil(b * k[2]::DOUBLE))) AS long_ok FROM q),
e AS (SELECT *, list_filter([CASE WHEN NOT complete THEN 'header contract failed: missing ' || coalesce(nullif(array_to_string(missing, ', '), ''), 'required fields') END, CASE WHEN NOT tldr_ok THEN 'tldr contract failed: takeaway count outside note contract bounds' END, CASE WHEN len(hits) > 0 THEN 'placeholder leakage detected: ' || array_to_string(hits, ', ') END, CASE WHEN len(dups) > 0 THEN 'duplicate case titles detected across chunk boundaries' END,
  CASE WHEN NOT actions_ok THEN 'action plan failed actionability threshold' END, CASE WHEN s >= 7200 AND NOT long_ok THEN 'deep longform coverage is too thin: add more cases and intermediate conclusions' END, CASE WHEN NOT dense THEN 'note is too compressed for source duration' END], lambda x: x IS NOT NULL) AS errors, CASE WHEN work_id % 17 = 0 THEN 3 ELSE 0 END AS shell FROM r)"""

BLOCK_PARTS = listed(
    "CASE WHEN doc_id % 3 = 0 THEN '# Блок 1: Topic  ' || doc_id % 20 WHEN doc_id % 3 = 1 THEN '## Topic ' || doc_id % 20 || ' (00:10–00:20)' END", "'0. too early'", "'### Тезисы:'", "'1. **Lead** Thesis ' || doc_id || '. '", f"'2. ' || {pick('doc_id', *ACTION_TEXTS)}",
    "'- plain bullet'", "'- *(01:00)* Bullet ' || doc_id", "'### Кейс: x'", "'3. too late'", when("doc_id % 2 = 0", "'**Вывод:** The end.'"),
)
BLOCK_LINES = f"b AS ({rows(BLOCK_PARTS, 'source AS work_id, doc_id AS block_key')})"
HEADING = squeeze(r"coalesce(nullif(regexp_extract(text, '^\s*#\s*Блок\s+\d+\s*:\s*(.+)$', 1), ''), regexp_extract(text, '^\s*##\s+(.+?)(?:\s+\([0-9:–-]+\))?\s*$', 1))")
CANDIDATES = rf"""{BLOCK_LINES}, b1 AS (SELECT *, nullif({HEADING}, '') AS h, regexp_matches(text, '^\s*###\s+Тезисы') AS th, regexp_matches(text, '^\s*###\s+') AS third, rtrim(text) AS t FROM b),
b2 AS (SELECT *, first_value(h IGNORE NULLS) OVER w AS topic, coalesce(last_value(CASE WHEN th THEN true WHEN third THEN false END IGNORE NULLS) OVER w, false) AS inside FROM b1 WINDOW w AS (PARTITION BY work_id, block_key ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b3 AS (SELECT *, CASE WHEN inside AND regexp_matches(t, '^\s*\d+\.\s+(.+)$') THEN regexp_extract(t, '^\s*\d+\.\s+(.+)$', 1) WHEN regexp_matches(t, '\*\([^)]+\)\*') AND regexp_matches(t, '^\s*[-*]\s*') THEN regexp_extract(t, '^\s*[-*]\s*(?:\*\([^)]+\)\*\s*)?(.+)$', 1) ELSE regexp_extract(t, '^\s*\*\*Вывод:\*\*\s*(.+)$', 1) END AS said FROM b2 WHERE NOT th),
ca AS (SELECT work_id, block_key, line_no, topic, statement FROM (SELECT *, {statement("said")} AS statement FROM b3) WHERE statement <> '')"""
MANIFEST = f"""m AS (SELECT source AS work_id, doc_id AS row_no, {label("(doc_id % 60)")} AS chunk_id, 'b' || doc_id AS block_file, CASE WHEN doc_id % 5 > 0 THEN 'Topic ' || doc_id % 20 END AS topic, {pick("doc_id", None, "— Claim one.", None, "Claim two")} AS primary_claim, {pick("doc_id // 2", None, " A  case ", "")} AS case_title, {pick("doc_id", "Ann Lee; Speaker 2", "—", None, "Bob Ray|Ann Lee")} AS names,
  {pick("doc_id", *ACTION_TEXTS[0:4], None, None)} AS action_now, {pick("doc_id // 2", *ACTION_TEXTS[4:8], None, None)} AS action_check, {pick("doc_id // 3", *ACTION_TEXTS[8:12], None, None)} AS action_avoid FROM documents)"""


def candidate(source: str, column: str, into: str) -> str:
    """SQL of the action candidates of a column, as tables that end in `into`, with the column `action`."""
    return f"""{into}_1 AS (SELECT *, {statement(f"coalesce({column}, '')")} AS _s FROM {source}), {into}_2 AS (SELECT *, strpos(_s, ':') AS _i, {squeeze(unquoted(strip("substr(_s, strpos(_s, ':') + 1)")))} AS _r FROM {into}_1),
{into} AS (SELECT * EXCLUDE (_s, _i, _r), regexp_replace({unquoted(strip(f"CASE WHEN _i > 0 AND _r <> '' AND {words(L.ACTION_PREFIX_MARKERS, 'lower(substr(_s, 1, _i - 1))')} THEN _r ELSE _s END"))}, '\\.+$', '') AS action FROM {into}_2)"""


def request(source: str, into: str) -> str:
    """SQL that makes requests of the column `action`."""
    first = "lower(regexp_replace(string_split(action, ' ')[1], '^[«»\".,:;!?]+|[«»\".,:;!?]+$', '', 'g'))"
    verbs = ", ".join(f"'{v}'" for v in L.IMPERATIVES)
    prefixed = " ".join(f"WHEN contains(lower(action), '{w}') THEN '{p}' || lower(substr(action, 1, 1)) || substr(action, 2)" for w, p in L.IMPERATIVE_PREFIXES)
    return f"{into} AS (SELECT * REPLACE (CASE WHEN action = '' OR {first} IN ({verbs}) THEN action {prefixed} ELSE action END AS action) FROM {source})"


LOW = "lower(action)"
SCORE = f"(2 * {counted(L.STRONG_ACTION, LOW)} + {counted(L.WEAK_ACTION, LOW)} - 2 * {counted(L.NO_ACTION, LOW)} + CAST(contains(action, '?') OR contains(action, '«') AS BIGINT) - CAST(length(action) > 220 AS BIGINT))"
BUCKET = f"CASE WHEN {SCORE} < 2 THEN NULL WHEN {words(L.IMMEDIATE_WORDS, LOW)} OR {words(L.IMMEDIATE_STARTS, LOW, 'starts_with')} THEN 'immediate' WHEN {words(L.ONGOING_WORDS, LOW)} OR {words(L.ONGOING_STARTS, LOW, 'starts_with')} THEN 'ongoing' ELSE 'month' END"
LIMIT = lambda x, n: f"CASE WHEN length({squeeze(x)}) <= {n} THEN {squeeze(x)} ELSE rtrim(substr({squeeze(x)}, 1, {n - 1})) || '…' END"
PLACEHOLDER = r"'^(|[—–-]|unknown|speaker|author|creator|uploader|speaker\s+\d+)$'"
CHUNK = label("doc_id")
FILES = f"fl AS (SELECT source AS work_id, unnest({listed(when('doc_id % 2 = 0', f"'chunk_' || ({CHUNK}) || '_block_01.md'"), when('doc_id % 3 > 0', f"'manifest_chunk_' || ({CHUNK}) || '.tsv'"), when('doc_id % 5 > 0', f"'summary_chunk_' || ({CHUNK}) || '.md'"), when('doc_id % 97 = 0', "'tldr.md'"), when('doc_id % 89 = 0', "'x.html'"), when('doc_id % 83 = 0', "'speakers.txt'"), when('doc_id % 79 = 0', "'header.md'"), when('doc_id % 71 = 0', "'appendix.md'"))}) AS name FROM documents)"
STAGES = f"""g AS (SELECT c_custkey AS work_id, {pick("c_custkey", "ready", "partial", "missing", "stale")} AS e, coalesce({pick("c_custkey // 4", "skip", "required", "optional", None)}, '') AS h, {pick("c_custkey // 2", "ready", "missing", "skipped")} AS sp, {pick("c_custkey // 3", "ready", "stale")} AS tl, {pick("c_custkey // 5", "ready", "missing")} AS asm, c_custkey % 12 + 1 AS c, {pick("c_custkey", "monologue", "conversation")} AS m, {pick("c_custkey // 7", "", "multi", None)} AS xm, c_custkey % 3 = 2 AS reused, 0 AS s FROM customer),
st AS (SELECT o_custkey AS work_id, {label("(o_orderkey % 100)")} AS chunk_id, o_orderkey % 5 > 0 AS planned, {pick("o_orderkey // 2", "missing", "ready", "missing", "partial", "stale")} AS status FROM orders)"""


def ids(test: str) -> str:
    return f"coalesce(string_agg(chunk_id, ',' ORDER BY length(chunk_id), chunk_id) FILTER (planned AND {test}), '')"


NEXT = "CASE WHEN h = 'required' AND sp NOT IN ('ready', 'skipped') THEN 'speaker-identification' WHEN e <> 'ready' THEN 'extract-chunks' WHEN tl <> 'ready' THEN 'generate-tldr' WHEN asm <> 'ready' THEN 'assemble' ELSE 'done' END"

SQL: dict[str, str] = {
    "note_contracts": f"""WITH {WORKS}, v AS (SELECT *, {BOUNDS} AS t FROM w) SELECT work_id, CASE WHEN {is_person(person("coalesce(author, '')"))} THEN 'Автор,' ELSE '' END || 'Формат,Тема,Длительность,Источник' AS required, CASE WHEN m <> 'monologue' THEN 'Участники' ELSE '' END AS optional, CASE m WHEN 'monologue' THEN 'лекция' WHEN 'conversation' THEN 'интервью' ELSE 'воркшоп' END AS format,
  CASE x WHEN 'single' THEN 'inline-extraction' WHEN 'micro-multi' THEN 'deterministic-merge' ELSE 'agent' END AS strategy, CAST(t[1] AS BIGINT) AS tldr_min, CAST(t[2] AS BIGINT) AS tldr_max, CASE WHEN s >= 7200 THEN 'preferred' ELSE 'optional' END AS case_section, CAST(7 AS BIGINT) AS sections FROM v""",
    "note_quality": f"""{QUALITY} SELECT work_id, wc AS word_count, complete AS header_complete, array_to_string(missing, ',') AS missing, array_to_string(hits, ',') AS hits, array_to_string(dups, ',') AS duplicates, meaning AS meaning_blocks, cases AS case_blocks, tldr_ok AS tldr_length_ok, actions_ok, dense AS density_ok, long_ok AS longform_ok, array_to_string(errors, '; ') AS errors,
  CAST(CASE WHEN shell <> 0 THEN shell WHEN len(errors) > 0 THEN 2 ELSE 0 END AS BIGINT) AS code, CASE WHEN shell <> 0 THEN 'failed' WHEN len(errors) > 0 THEN 'contract-failed' ELSE 'assembled' END AS status,
  CASE WHEN len(errors) > 0 THEN CASE WHEN work_id % 8 = 0 THEN 'skipped-by-request' WHEN work_id % 3 > 0 THEN 'contract-errors' ELSE 'disabled' END WHEN work_id % 8 = 0 THEN 'skipped-by-request' WHEN work_id % 5 = 0 THEN 'already-delivered-current-html' WHEN work_id % 3 = 0 THEN 'disabled' END AS reason FROM e""",
    "quality_summaries": f"{QUALITY} SELECT work_id, CAST(len(errors) AS BIGINT) AS contract_errors, complete AS header_complete, tc AS tldr_count, tldr_ok AS tldr_length_ok, len(hits) = 0 AS placeholder_ok, len(dups) = 0 AS duplicate_case_titles_ok, actions_ok AS actionability_ok, dense AS detail_density_ok, long_ok AS deep_longform_ok FROM e",
    "quotes_and_cases": rf"{NOTES} SELECT work_id, count(*) FILTER (regexp_matches(text, '^\s*>\s')) AS quotes, count(*) FILTER (regexp_matches(text, '^###\s+Кейс:')) AS cases FROM n GROUP BY work_id",
    "prepare_quality": f"""WITH o AS (SELECT o_orderkey, o_orderkey * 37 % 11000 AS s, o_orderkey % 12 + 1 AS c, {pick("o_orderkey", "monologue", "conversation", "workshop")} AS m, {pick("o_orderkey // 3", "single", "micro-multi", "multi")} AS x, {pick("o_orderkey // 2", "skip", "optional", "required", "odd")} AS st, {pick("o_orderkey // 5", "youtube", "local", None)} AS k, {pick("o_orderkey", "Ann Lee", "12:30")} AS a FROM orders),
p AS (SELECT *, m = 'monologue' AND coalesce(k, '') = 'youtube' AND a = 'Ann Lee' AS expected, CASE WHEN s > 0 THEN round(CAST(c / (s / 60.0::DOUBLE) * 10 AS DECIMAL(38, 17)), 2) END AS per, CASE WHEN s >= 9000 THEN 0.85 WHEN s >= 5400 THEN 0.75 WHEN s >= 2700 THEN 0.6 WHEN s >= 1200 THEN 0.5 ELSE 0 END AS least FROM o)
SELECT o_orderkey, st <> 'odd' AS routing_ok, expected AS fast_path_expected, NOT expected OR (st = 'skip' AND x IN ('single', 'micro-multi')) AS fast_path_ok, per IS NULL OR (per >= least AND per <= 1.8) AS fragmentation_ok, CAST(floor(per * 100 + 0.5) AS BIGINT) AS per_10min_x100 FROM p""",
    "header_seeds": f"""WITH d AS (SELECT doc_id AS work_id, nullif({strip("coalesce(" + pick("doc_id", " Ann ", None, " ") + ", '')")}, '') AS a FROM documents) SELECT work_id, CASE WHEN work_id % 4 > 0 THEN 'x' ELSE 'T' || work_id END AS topic_hint, CASE WHEN work_id % 2 = 1 THEN 'multi-speaker or interview' WHEN a IS NOT NULL THEN 'single-speaker (likely ' || a || ')' ELSE 'single-speaker' END AS participants_hint, a AS author_hint FROM d""",
    "title_candidates": f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS f, {pick("doc_id", "@Ann Lee", "creator", None)} AS a FROM documents), n AS (SELECT doc_id, list_concat(list_filter([{person("coalesce(a, '')")}], lambda x: {is_person("x")}), [f, '# Chapter one', '12:30', 'chapter ONE', '**Hint** ' || doc_id % 5, 'lecture', f, '> Last one', 'abc', 'Final words']) AS ts FROM d),
c AS (SELECT doc_id, list_filter(list_transform(ts, lambda x: {title("x")}), lambda x: {is_title("x")}) AS ts FROM n) SELECT doc_id, array_to_string(list_filter(ts, lambda x, i: list_position(list_transform(ts, lambda y: lower(y)), lower(x)) = i)[1:6], '|') AS titles FROM c""",
    "local_titles": rf"""WITH d AS (SELECT doc_id, {pick("doc_id", "transcript", "deep_learning-intro", "12:30")} AS stem, {pick("doc_id // 2", "good_folder", "notes")} AS parent, [{pick("doc_id", "00:10", "", "lecture")}, CASE doc_id % 4 WHEN 0 THEN '# Heading here' WHEN 1 THEN string_split(coalesce(text, ''), chr(10))[1] ELSE '*12:30*' END] AS ls FROM documents),
t AS (SELECT *, list_filter(list_transform(ls, lambda x: {{'t': {title("x")}, 'h': regexp_matches(x, '^\s*#\s+')}}), lambda x: {is_title("x.t")})[1] AS f FROM d)
SELECT doc_id, CASE WHEN f IS NOT NULL THEN CASE WHEN NOT f.h AND stem = 'transcript' AND parent = 'good_folder' THEN 'Good folder' ELSE f.t END WHEN stem = 'deep_learning-intro' THEN 'Deep learning intro' WHEN parent = 'good_folder' THEN 'Good folder' WHEN stem = 'transcript' THEN 'transcript' ELSE '12:30' END AS title FROM t""",
    "text_scalars": rf"""WITH d AS (SELECT *, substr(replace(coalesce(text, ''), chr(10), ' '), 1, 60) AS f FROM documents), v AS (SELECT *, {pick("doc_id", "youtube", "local", "other")} AS kind, {strip(pick("doc_id // 2", " https://a.b ", ""))} AS url, string_split(f, ' ') AS ws FROM d), n AS (SELECT *, regexp_replace({squeeze(r"regexp_replace(" + strip("regexp_replace(f || (['' || ' <a>?', chr(13) || chr(10) || 'b.', ' . '])[CAST(doc_id % 3 + 1 AS INT)], '[\\r\\n]+', ' ', 'g')") + ", '[<>:\"/\\\\|?*]+', ' ', 'g')")}, '^[ .]+|[ .]+$', '', 'g') AS nm FROM v)
SELECT doc_id, {statement("(" + pick("doc_id", "**Lead:** ", "— ", "") + " || f || " + pick("doc_id // 2", "...", " *(12:30)*", "") + ")")} AS statement, coalesce(nullif(rtrim(substr(array_to_string(regexp_extract_all(lower(regexp_replace(strip_accents(f), '[^\x00-\x7F]', '', 'g')), '[a-z0-9]+'), '-'), 1, 72), '-'), ''), 'notes') AS slug,
  sha256(regexp_replace({strip("replace(coalesce(text, ''), chr(10), repeat(chr(10), 4))")}, '\n{{3,}}', chr(10) || chr(10), 'g')) AS collapsed, regexp_replace(substr(CASE WHEN nm = '' THEN 'Конспект' ELSE nm END, 1, 120), '[ .]+$', '') || '.html' AS file_name, (['ru', 'en', 'ru', 'de', NULL])[CAST(doc_id % 5 + 1 AS INT)] AS language, CASE WHEN doc_id % 3 = 0 THEN 'de' END AS hint,
  array_to_string(list_filter(list_transform(list_concat(string_split_regex(f, '[\n,]+'), string_split_regex({"(['a,b' || chr(10) || ' a', ''])[CAST(doc_id % 2 + 1 AS INT)]"}, '[\n,]+')), lambda x: {strip("x")}), lambda x, i: x <> '' AND list_position(list_transform(list_concat(string_split_regex(f, '[\n,]+'), string_split_regex({"(['a,b' || chr(10) || ' a', ''])[CAST(doc_id % 2 + 1 AS INT)]"}, '[\n,]+')), lambda y: {strip("y")}), x) = i), '|') AS refs,
  CASE kind WHEN 'youtube' THEN '📝 Конспект видео: ' WHEN 'local' THEN '📝 Конспект материала: ' ELSE '📝 Конспект: ' END || f || CASE WHEN kind = 'youtube' THEN chr(10) || coalesce(nullif(url, ''), 'f.mp3') WHEN kind = 'local' THEN chr(10) || 'Файл: f.mp3' ELSE '' END AS caption, array_to_string(list_filter(ws, lambda x, i: list_position(list_transform(ws, lambda y: lower(y)), lower(x)) = i), ' ') AS distinct_words FROM n""",
    "note_ids": f"""WITH d AS (SELECT doc_id, {pick("doc_id", None, None, None, "own")} AS own, {pick("doc_id", "youtube", "telegram", "local")} AS kind, {pick("doc_id // 2", "vid", None)} AS v, nullif({pick("doc_id", "chat", "")}, '') AS c, {pick("doc_id", "7", None, "8")} AS m, nullif(trim({pick("doc_id // 3", "/p", None, " ")}), '') AS p, nullif({pick("doc_id // 4", "https://u", "")}, '') AS u FROM documents)
SELECT doc_id, CASE WHEN own IS NOT NULL THEN own WHEN kind = 'youtube' AND v IS NOT NULL THEN 'youtube:' || v WHEN kind = 'telegram' AND c IS NOT NULL AND m IS NOT NULL THEN 'telegram:' || c || ':' || m WHEN p IS NOT NULL THEN 'file:' || sha1(p) WHEN u IS NOT NULL THEN 'url:' || sha1(u) ELSE 'bundle:' || sha1(CAST(doc_id AS VARCHAR)) END AS note_id FROM d""",
    "caption_texts": f"""SELECT doc_id, sha256({squeeze("'A & B ' || replace(coalesce(text, ''), '&', 'and') || ' it''s'")}) AS sha256 FROM documents""",
    "merged_objects": """WITH d AS (SELECT doc_id, json_merge_patch(CAST('{"a": ' || doc_id || ', "b": {"x": 1, "y": [1, 2]}, "c": {"z": 1}}' AS JSON), CAST(CASE doc_id % 3 WHEN 0 THEN '{"b": {"y": [3], "w": ' || doc_id || '}, "d": "n"}' WHEN 1 THEN '{"c": 5}' ELSE '{}' END AS JSON)) AS m FROM documents)
SELECT doc_id, m->>'$.a' AS a, m->>'$.b.x' AS x, m->>'$.b.y' AS y, m->>'$.b.w' AS w, m->>'$.c' AS c, m->>'$.d' AS d, CAST(doc_id AS VARCHAR) AS map_a, CASE WHEN doc_id % 2 = 0 THEN '2' END AS map_b, CAST(doc_id AS VARCHAR) AS map_c FROM d""",
    "block_candidates": f"WITH {CANDIDATES} SELECT * FROM ca",
    "block_topics": f"WITH {BLOCK_LINES}, h AS (SELECT *, {HEADING} AS h FROM b) SELECT work_id, block_key, arg_min(h, line_no) AS topic FROM h WHERE h <> '' GROUP BY ALL",
    "note_topics": f"""WITH {BLOCK_LINES}, {MANIFEST}, h AS (SELECT *, {HEADING} AS h FROM b), bt AS (SELECT work_id, block_key, arg_min(h, line_no) AS topic FROM h WHERE h <> '' GROUP BY ALL), u AS (SELECT work_id, topic, (0, length(chunk_id), chunk_id, row_no) AS o FROM m WHERE topic IS NOT NULL UNION ALL SELECT work_id, topic, (1, 0, '', block_key) FROM bt),
c AS (SELECT work_id, topic, count(*) AS n, min(o) AS f FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY n DESC, f) AS rank FROM c) SELECT work_id, topic, n, rank FROM r WHERE rank <= 8""",
    "topic_descriptions": f"""WITH {CANDIDATES}, {MANIFEST}, u AS (SELECT work_id, topic, {statement("coalesce(primary_claim, '')")} AS d, (0, length(chunk_id), chunk_id, row_no, 0) AS o FROM m UNION ALL SELECT work_id, topic, 'Кейс: ' || nullif({squeeze("case_title")}, ''), (0, length(chunk_id), chunk_id, row_no, 1) FROM m UNION ALL SELECT work_id, topic, statement, (1, 0, '', block_key, line_no) FROM ca)
SELECT work_id, topic, arg_min(d, o) AS description FROM u WHERE topic <> '' AND d <> '' GROUP BY ALL""",
    "described_topics": f"""WITH top AS (SELECT CASE WHEN item_id % 5 = 4 THEN 'no ' || item_id ELSE text END AS topic, item_id AS rank FROM benchmark), {LINES}, l AS (SELECT (doc_id, line_no) AS pos, text AS line FROM dl),
tk AS (SELECT DISTINCT topic, unnest(list_distinct({TOPIC_TOKENS.replace("{0}", "topic")})) AS tok FROM top), lk AS (SELECT pos, line, unnest(list_distinct({TOPIC_TOKENS.replace("{0}", "line")})) AS tok FROM l), sc AS (SELECT topic, pos, line, count(*) AS k FROM tk JOIN lk USING (tok) GROUP BY ALL), be AS (SELECT topic, line FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY k DESC, pos) AS n FROM sc) WHERE n = 1),
tt AS (SELECT topic, 'Told ' || repeat('word ', CAST(rank AS INT)) AS told FROM top WHERE rank % 2 = 0)
SELECT topic, rank, CASE WHEN told IS NOT NULL THEN {LIMIT("told", 180)} WHEN line IS NOT NULL THEN {LIMIT("line", 180)} ELSE '{L.TOPIC_FALLBACK}' END AS description FROM top LEFT JOIN tt USING (topic) LEFT JOIN be USING (topic)""",
    "entity_lines": f"""WITH {MANIFEST}, p AS (SELECT work_id, {strip("name")} AS name, coalesce(topic, block_file) AS context FROM (SELECT *, unnest(string_split_regex(coalesce(names, ''), '[;|,]\\s*')) AS name FROM m)),
d AS (SELECT DISTINCT work_id, name, context FROM p WHERE NOT regexp_matches(lower({squeeze("name")}), {PLACEHOLDER})) SELECT work_id, name, {LIMIT("array_to_string(list(context ORDER BY context)[1:2], '; ')", 140)} AS contexts FROM d GROUP BY ALL""",
    "people_lines": f"""WITH {MANIFEST}, p AS (SELECT work_id, {strip("name")} AS name, coalesce(topic, block_file) AS context FROM (SELECT *, unnest(string_split_regex(coalesce(names, ''), '[;|,]\\s*')) AS name FROM m) UNION ALL SELECT DISTINCT source, 'Cid Fox', '{L.AUTHOR_CONTEXT}' FROM documents WHERE source LIKE '%1' UNION ALL SELECT DISTINCT source, unnest(CASE WHEN source LIKE '%1' THEN ['Dan Elk'] ELSE ['Cid Fox', 'Dan Elk'] END), '{L.CANDIDATE_CONTEXT}' FROM documents),
d AS (SELECT DISTINCT work_id, name, context FROM p WHERE NOT regexp_matches(lower({squeeze("name")}), {PLACEHOLDER})) SELECT work_id, name, {LIMIT("array_to_string(list(context ORDER BY context)[1:2], '; ')", 140)} AS contexts FROM d GROUP BY ALL""",
    "note_actions": f"""WITH {CANDIDATES}, {MANIFEST}, s0 AS (SELECT work_id, 'immediate' AS bucket, action_now AS x, (0, length(chunk_id), chunk_id, row_no, 0) AS o FROM m UNION ALL SELECT work_id, 'month', action_check, (1, length(chunk_id), chunk_id, row_no, 0) FROM m UNION ALL SELECT work_id, 'ongoing', action_avoid, (2, length(chunk_id), chunk_id, row_no, 0) FROM m),
{candidate("s0", "x", "s1")}, {request("s1", "s2")}, {candidate("(SELECT work_id, bucket, o, action AS y FROM s2)", "y", "s3")}, {request("s3", "s4")}, {candidate("(SELECT work_id, statement, (3, 0, '', block_key, line_no) AS o FROM ca)", "statement", "f1")},
u1 AS (SELECT work_id, bucket, action, o FROM s4 WHERE action <> '' UNION ALL SELECT work_id, {BUCKET}, action, o FROM f1 WHERE {SCORE} >= 2), sure AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY work_id, lower(action) ORDER BY o) AS k FROM u1 WHERE action <> '' AND bucket IS NOT NULL) WHERE k = 1),
few AS (SELECT DISTINCT source AS work_id FROM documents WHERE source NOT IN (SELECT work_id FROM sure GROUP BY work_id HAVING count(*) >= 5)), l0 AS (SELECT work_id, (4, 0, '', doc_id, 0) AS o, {statement("'запиши вопрос ' || array_to_string(string_split(string_split(coalesce(text, ''), chr(10))[1], ' ')[1:3], ' ') || ' сегодня'")} AS z FROM documents JOIN few ON work_id = source), {candidate("l0", "z", "l1")},
u2 AS (SELECT work_id, bucket, action, o FROM sure UNION ALL SELECT work_id, {BUCKET}, action, o FROM l1 WHERE action <> '' AND {SCORE} >= 3), fin AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY work_id, lower(action) ORDER BY o) AS k FROM u2 WHERE bucket IS NOT NULL) WHERE k = 1), r AS (SELECT *, row_number() OVER (PARTITION BY work_id, bucket ORDER BY o) AS rank FROM fin)
SELECT work_id, bucket, rank, action FROM r WHERE rank <= CASE WHEN bucket = 'ongoing' THEN 6 ELSE 5 END""",
    "appendices": """WITH d AS (SELECT doc_id AS w, doc_id % 2 = 0 AS p, doc_id % 3 = 0 AS r, doc_id % 2 = 1 AS i, doc_id % 5 = 0 AS m, doc_id % 7 = 0 AS o, doc_id % 4 > 0 AS t, chr(10) AS n FROM documents)
SELECT w AS work_id, concat_ws(n, '# Упомянутые люди и ресурсы', CASE WHEN NOT p AND NOT r THEN n || '- Имена и ресурсы не были явно извлечены из материалов.' ELSE n || '## Люди' || n || CASE WHEN p THEN '- **Ann:** in ' || w || '.' || n || '- **Bob:** in ' || w || '.' ELSE '- Явно названные люди не были извлечены из материалов.' END || n || n || '## Ресурсы' || n || CASE WHEN r THEN '- **Miro:** board.' ELSE '- Явно названные книги, инструменты или сервисы не были извлечены из материалов.' END END,
  CASE WHEN i OR m OR o THEN concat_ws(n, n || '---' || n || n || '# План действий' || n || n || '### Прямо сейчас', CASE WHEN i THEN '- [ ] do immediate 1' || n || '- [ ] do immediate 2' END, CASE WHEN m THEN n || '### На этой неделе' || n || '- [ ] do month 1' || n || '- [ ] do month 2' END, CASE WHEN o THEN n || '### На постоянной основе' || n || '- [ ] do ongoing 1' || n || '- [ ] do ongoing 2' END) END,
  n || '---' || n || n || '# Ключевые идеи и модели' || n || CASE WHEN t THEN '- **Topic 1:** told' || n || '- **Topic 2:** told' ELSE '- Явные модели и повторяющиеся идеи не были извлечены из материалов.' END) || n AS appendix FROM d""",
    "artifact_counts": rf"WITH {FILES} SELECT work_id, count(*) FILTER (regexp_matches(name, '^chunk_.+_block_.+\.md$')) AS blocks, count(*) FILTER (regexp_matches(name, '^manifest_chunk_.+\.tsv$')) AS manifests, count(*) FILTER (regexp_matches(name, '^summary_chunk_.+\.md$')) AS summaries, count(*) FILTER (name LIKE '%.html') AS html, bool_or(name = 'tldr.md') AS has_tldr, bool_or(name = 'header.md') AS has_header, bool_or(name = 'appendix.md') AS has_appendix, bool_or(name = 'speakers.txt') AS has_speakers FROM fl GROUP BY work_id",
    "chunk_statuses": f"""WITH {FILES}, d AS (SELECT source AS work_id, doc_id, {CHUNK} AS chunk_id FROM documents), ob AS (SELECT work_id, nullif(coalesce(nullif(regexp_extract(name, '^chunk_([A-Za-z0-9]+)_block_\\d+\\.md$', 1), ''), regexp_extract(name, '^manifest_chunk_([A-Za-z0-9]+)\\.tsv$', 1)), '') AS chunk_id, name LIKE 'chunk%' AS b FROM fl), ok AS (SELECT work_id, chunk_id, count(*) FILTER (b) AS blocks, bool_or(NOT b) AS manifest FROM ob WHERE chunk_id IS NOT NULL GROUP BY ALL),
x AS (SELECT d.*, doc_id % 7 <> 6 AS planned, coalesce(blocks, 0) > 0 AS b, coalesce(manifest, false) AS mf, doc_id % 4 > 0 AS sent, {pick("doc_id", "f", "g", "")} AS fp, {pick("doc_id // 2", "f", "g", "f")} AS told, doc_id % 3 > 0 AS hm, doc_id % 5 > 0 AS hs, doc_id % 8 = 1 AS one, ok.work_id IS NOT NULL AS seen FROM d LEFT JOIN ok USING (work_id, chunk_id))
SELECT work_id, chunk_id, planned, CASE WHEN NOT planned THEN CASE WHEN b OR mf THEN 'stale' ELSE 'missing' END WHEN sent THEN CASE WHEN fp <> '' AND fp <> told THEN 'stale' WHEN CASE WHEN one THEN hm ELSE hm AND hs END AND (b OR mf) THEN 'ready' WHEN hm OR (hs AND NOT one) OR b OR mf THEN 'partial' ELSE 'missing' END WHEN b AND mf THEN 'ready' WHEN b OR mf THEN 'partial' ELSE 'missing' END AS status FROM x WHERE planned OR seen""",
    "execution_plans": f"""WITH {STAGES}, l AS (SELECT work_id, {ids("status <> 'ready'")} AS pe, {ids("status = 'ready'")} AS re, {ids("status = 'partial'")} AS pa, bool_or(status IN ('ready', 'partial')) AS begun FROM st GROUP BY work_id), y AS (SELECT g.*, pe, re, pa, begun, coalesce(nullif(xm, ''), {MODES}) AS mode FROM g LEFT JOIN l USING (work_id)),
z AS (SELECT *, mode IN ('micro-multi', 'multi') AS several, mode IN ('micro-multi', 'multi') AND h <> 'skip' AND sp NOT IN ('ready', 'skipped') AS rs FROM y), v AS (SELECT *, list_filter([CASE WHEN rs THEN 'speaker_identification' END, CASE WHEN e <> 'ready' THEN 'extraction' END, CASE WHEN several AND tl <> 'ready' THEN 'tldr' END], lambda x: x IS NOT NULL) AS bl FROM z)
SELECT work_id, mode, {NEXT} AS next_action, reused OR coalesce(begun, false) AS resume, rs AS run_speaker, e <> 'ready' AS run_extraction, several AND e = 'ready' AND tl <> 'ready' AS run_tldr, CASE mode WHEN 'single' THEN 'inline-extraction' WHEN 'micro-multi' THEN 'deterministic-merge' ELSE 'agent' END AS tldr_strategy, several AND e = 'ready' AND tl <> 'ready' AND h <> 'skip' AS rename_speakers, asm <> 'ready' AND len(bl) = 0 AS run_assemble,
  coalesce(pe, '') AS pending_chunk_ids, coalesce(re, '') AS ready_chunk_ids, coalesce(pa, '') AS partial_chunk_ids, array_to_string(bl, ',') AS blocked_by FROM v""",
    "status_payloads": f"""WITH {STAGES}, c AS (SELECT work_id, count(*) AS n, count(*) FILTER (status = 'ready') AS r, count(*) FILTER (status = 'partial') AS p, count(*) FILTER (status = 'missing') AS mi, count(*) FILTER (status = 'stale') AS sl FROM st WHERE planned GROUP BY work_id), f AS (SELECT o_custkey AS work_id, count(*) FILTER (o_orderkey % 4 = 0) AS b, count(*) FILTER (o_orderkey % 4 = 3) AS su, count(*) FILTER (o_orderkey % 4 = 1) AS ht FROM orders GROUP BY ALL)
SELECT work_id, {NEXT} AS next_action, n AS planned_chunks, r AS ready_chunks, p AS partial_chunks, mi AS missing_chunks, sl AS stale_chunks, b AS blocks, su AS summaries, ht AS html, CASE WHEN b IS NOT NULL THEN false END AS has_header FROM g LEFT JOIN c USING (work_id) LEFT JOIN f USING (work_id)""",
    "loaded_states": "SELECT c_custkey AS work_id, CASE WHEN c_custkey % 6 = 0 THEN 'state' WHEN c_custkey % 4 > 0 THEN 'plan' WHEN c_custkey % 5 > 0 THEN 'report' END AS mode, CASE WHEN c_custkey % 3 = 0 THEN c_custkey WHEN c_custkey % 5 > 0 THEN c_custkey * 2 END AS chunks, CASE WHEN c_custkey % 4 > 0 THEN 'p' WHEN c_custkey % 5 > 0 THEN 'r' END AS stage FROM customer",
    "normalised_plans": f"WITH d AS (SELECT doc_id AS n, trim(coalesce(nullif({pick('doc_id', ' A ', '', None)}, ''), {pick('doc_id // 3', '7', None, '  ')}, '')) AS chunk_id FROM documents) SELECT n, chunk_id FROM d WHERE chunk_id <> ''",
    "newer_sources": "WITH n AS (SELECT user_id AS work_id, max(event_id * 7 % 1000) AS newest FROM events GROUP BY user_id), m AS (SELECT c_custkey AS work_id, CASE WHEN c_custkey % 9 > 0 THEN 990 + c_custkey % 10 END AS made FROM customer WHERE c_custkey % 3 > 0) SELECT work_id FROM n LEFT JOIN m USING (work_id) WHERE made IS NULL OR newest > made",
    "reusable_works": "SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 12) AS fingerprint FROM documents WHERE coalesce(text, '') IN (SELECT coalesce(text, '') FROM documents WHERE doc_id % 3 = 0)",
    "run_timeline": f"""WITH r AS (SELECT event_id AS run_id, user_id AS note_id, {pick("event_id", "assembled", "failed")} AS status, event_type AS title, {pick("event_id // 3", "t1", "t2")} AS transcript, {pick("event_id", "h", "")} AS html, {pick("event_id // 2", None, "d")} AS dv, ts FROM events), l AS (SELECT *, row_number() OVER w = 1 AS first_run, lag(transcript) OVER w AS t0, lag(html) OVER w AS h0, lag(dv) OVER w AS d0 FROM r WINDOW w AS (PARTITION BY note_id ORDER BY ts, run_id)),
f AS (SELECT *, first_run OR transcript <> t0 AS input_changed, first_run OR html <> h0 AS output_changed, CASE WHEN first_run THEN dv IS NOT NULL ELSE dv IS DISTINCT FROM d0 END AS delivery_changed FROM l)
SELECT run_id, note_id, status, title, transcript, first_run, input_changed, output_changed, delivery_changed, NOT first_run AND NOT input_changed AND NOT output_changed AND NOT delivery_changed AS only_resume FROM f""",
    "transcribe_backends": f"SELECT doc_id, CASE WHEN c <> 'auto' THEN c WHEN doc_id % 3 = 0 THEN 'groq' WHEN doc_id % 2 = 0 AND doc_id % 5 > 1 THEN 'parakeet' END AS backend FROM (SELECT doc_id, lower(trim({pick('doc_id', ' Auto', 'Groq ', 'whisperx', 'auto')})) AS c FROM documents)",
    "retried_requests": f"""WITH e AS (SELECT event_id // 6 AS r, event_id % 6 AS n, user_id % 7 = 3 AS ok, user_id % 3 = 0 AS lim, coalesce(regexp_extract({pick("user_id", "try again in 1m12s", "in 3m0s", "busy", None)}, 'in (\\d+)m(\\d+)s', ['m', 's']), {{'m': '', 's': ''}}) AS t FROM events),
w AS (SELECT *, CASE WHEN ok THEN NULL WHEN lim THEN CASE WHEN (CASE WHEN t.m <> '' THEN TRY_CAST(t.m AS INT) * 60 + TRY_CAST(t.s AS INT) + 5 ELSE 180 END) <= 120 AND n < 5 THEN (CASE WHEN t.m <> '' THEN TRY_CAST(t.m AS INT) * 60 + TRY_CAST(t.s AS INT) + 5 ELSE 180 END) END WHEN n < 4 THEN 10 * (n + 1) END AS wait FROM e),
x AS (SELECT *, min(CASE WHEN ok OR wait IS NULL OR n >= 4 THEN n END) OVER (PARTITION BY r) AS stop FROM w)
SELECT r AS request_id, count(*) AS tries, CAST(coalesce(sum(wait), 0) AS BIGINT) AS waited, CASE WHEN bool_or(ok) THEN 'done' WHEN max(stop) IS NOT NULL THEN 'gave-up' ELSE 'open' END AS outcome FROM x WHERE stop IS NULL OR n <= stop GROUP BY r""",
    "host_checks": """WITH h AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS mac FROM customer), r AS (SELECT *, k % 7 = 0 OR (mac AND (k % 4 = 0 OR k % 6 = 0)) AS ready FROM h)
SELECT k AS host, concat_ws(',', CASE WHEN k % 3 = 0 THEN 'curl' END, CASE WHEN k % 2 = 1 THEN 'ffmpeg' END, CASE WHEN k % 5 > 0 THEN 'pandoc' END) AS missing_tools, ready AS audio_ready, CASE WHEN NOT ready THEN CASE WHEN mac THEN 'install a local backend or set a key' ELSE 'set a key' END END AS hint FROM r""",
    "delivery_summaries": "SELECT doc_id AS work_id, CAST(1 + CAST(doc_id % 3 = 0 AS INT) + CAST(doc_id % 5 > 0 AS INT) AS BIGINT) AS fields, CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END AS enabled, CASE WHEN doc_id % 3 = 0 THEN 'r' END AS reason FROM documents",
}
