"""DuckDB SQL of the queries over landed texts: the rule, from the rows that the texts were written from."""

from __future__ import annotations

from colloquy.plans.base_oracles import CONVERSATION_LINES, MODES, WORKS, label, meta, pad, person, squeeze, strip, target_lines

TURNS = "t AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS doc_id, turn, role, replace(coalesce(text, ''), chr(10), ' ') AS text FROM conversations)"
KINDS = f"WITH {TURNS}, k AS (SELECT *, conv_id % 6 AS kind, turn * 7 AS s, {strip('text')} AS said FROM t), "
SEGMENTS = KINDS + "g AS (SELECT *, CASE WHEN kind <> 1 THEN role END AS speaker, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS seg_no FROM k WHERE kind < 3 AND said <> ''), rest AS (SELECT doc_id, kind, arg_min(text, turn) AS first FROM k WHERE kind > 2 GROUP BY ALL)"
STAMP = f"'*' || ({pad('s // 60')}) || ':' || ({pad('s % 60')}) || '* ' || said"
NO_TEXT = "CASE WHEN kind = 5 OR " + strip("first") + " = '' THEN 'no segments or text' END"


def pick(k: str, *values: str | None) -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v + "'" for v in values)
    return f"([{quoted}])[CAST(({k}) % {len(values)} + 1 AS INT)]"


def is_person(x: str) -> str:
    return rf"(length({strip(x)}) >= 2 AND NOT regexp_matches({strip(x)}, '(?i)^speaker\s+\d+$') AND NOT regexp_matches({strip(x)}, '^[\d\s:._/\-]+$') AND lower({strip(x)}) NOT IN ('author', 'creator', 'uploader', 'channel'))"


#: The plan of conversations, each a work of one file and one chunk: stage, mode, sizes.
PLANS = f"WITH {CONVERSATION_LINES}, {meta('cl')} {WORKS.replace(chr(39) + 'corpus' + chr(39), 'doc_id')}, pl AS (SELECT w.work_id, w.lines, w.speaker_stage, w.content_mode, w.duration_seconds, {target_lines('w.lines')} AS target, CAST(greatest(10, least(24, round_even(w.lines * 0.08::DOUBLE, 0))) AS BIGINT) AS overlap, CASE WHEN w.speaker_stage = 'skip' THEN 40 ELSE 200 END AS prescan FROM w)"
REASON = "CASE speaker_stage WHEN 'required' THEN 'multiple speaker markers or dialog cues detected' WHEN 'skip' THEN 'single-speaker or lecture-style transcript with weak dialog cues and at most one intro cue' ELSE 'speaker identification may help, but content can be processed safely without it' END"
CLOCK = f"({pad('duration_seconds // 60')}) || ':' || ({pad('duration_seconds % 60')})"

SQL: dict[str, str] = {
    "webvtt_cues": rf"""WITH c AS (SELECT conv_id, turn, {squeeze("'A & B: ' || replace(text, chr(10), ' ')")} AS text FROM conversations),
a AS (SELECT conv_id, turn, 0 AS n, text FROM c UNION ALL SELECT conv_id, turn, 1, text FROM c WHERE turn % 2 = 0), b AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, n) AS before FROM a)
SELECT CAST(conv_id AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, n) AS cue_no, CAST((turn * 10 + n) * 1000 + 500 AS BIGINT) AS start_ms, text FROM b WHERE before IS NULL OR before <> text""",
    "caption_service_cues": f"WITH {TURNS} SELECT doc_id, turn + 1 AS cue_no, CAST(turn * 2500 AS BIGINT) AS start_ms, text FROM t WHERE turn % 3 <> 2 AND {strip('text')} <> ''",
    "line_breaks": r"""WITH d AS (SELECT doc_id, replace(text, chr(10), ([chr(10), chr(13) || chr(10), chr(13), chr(11), chr(12), chr(28), chr(133), chr(8232)])[CAST(doc_id % 8 + 1 AS INT)]) AS text FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x{0B}\x{0C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]') AS p FROM d), c AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[:len(p) - 1] ELSE p END AS ls FROM s)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS lines, CAST(list_sum(list_transform(ls, lambda x: length(x))) AS BIGINT) AS chars, ls[len(ls)] AS last_line FROM c WHERE len(ls) > 0""",
    "binary_files": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN (doc_id % 10) / (doc_id % 10 + 10) > 0.3 ELSE false END AS binary FROM documents",
    "adjacent_transcripts": "SELECT '/m/' || doc_id || '.mp3' AS path, CASE WHEN doc_id % 4 = 0 THEN '/m/' || doc_id || '.json' END AS json_path FROM documents",
    "recognised_lines": f"{SEGMENTS} SELECT doc_id, seg_no AS line_no, {STAMP} AS text, CAST(NULL AS VARCHAR) AS error FROM g UNION ALL SELECT doc_id, 1, CASE WHEN kind < 5 THEN '*00:00* ' || nullif({strip('first')}, '') END, {NO_TEXT} FROM rest",
    "recognised_speaker_lines": f"{SEGMENTS}, m AS (SELECT *, max(speaker) OVER (PARTITION BY doc_id) <> min(speaker) OVER (PARTITION BY doc_id) AS many FROM g) SELECT doc_id, seg_no AS line_no, CASE WHEN many THEN '**Speaker ' || speaker || '** ' ELSE '' END || {STAMP} AS text, CAST(NULL AS VARCHAR) AS error FROM m UNION ALL SELECT doc_id, 1, CASE WHEN kind < 5 THEN nullif({strip('first')}, '') END, {NO_TEXT} FROM rest",
    "diarized_markdown": rf"""{SEGMENTS}, n AS (SELECT *, coalesce(dense_rank() OVER (PARTITION BY doc_id ORDER BY speaker), 1) AS r FROM g), i AS (SELECT *, sum(CASE WHEN lag_r = r THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seg_no) AS island FROM (SELECT *, lag(r) OVER (PARTITION BY doc_id ORDER BY seg_no) AS lag_r FROM n)),
j AS (SELECT doc_id, island, min(r) AS r, string_agg(said, ' ' ORDER BY seg_no) AS said, min(s) AS s FROM i GROUP BY ALL)
SELECT doc_id, regexp_replace(string_agg('**Speaker ' || r || '**: ' || said || chr(10) || '*' || ({pad("s // 60")}) || ':' || ({pad("s % 60")}) || '*' || chr(10), chr(10) ORDER BY island), '\s+$', '') || chr(10) AS text FROM j GROUP BY doc_id""",
    "payload_segments": f"{SEGMENTS} SELECT doc_id, count(*) AS segments, count(speaker) AS named, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(length(said)) AS BIGINT) AS chars FROM g GROUP BY doc_id",
    "shifted_segments": f"WITH {TURNS} SELECT conv_id // 3 AS doc_id, row_number() OVER (PARTITION BY conv_id // 3 ORDER BY conv_id % 3, turn) AS seg_no, CAST(turn * 7 + conv_id % 3 * 600 AS BIGINT) AS start_s, role AS speaker, text FROM t",
    "chapters": rf"""WITH {TURNS}, g AS (SELECT doc_id, turn, CAST(floor(turn * 75.5) AS BIGINT) AS s, role || '  ' || turn AS title FROM t WHERE conv_id % 3 = 0 AND turn <> 1),
d AS (SELECT doc_id, turn, turn * 60 + turn * 3 AS s, role || ' told' AS title, count(*) OVER (PARTITION BY doc_id) AS n FROM t WHERE conv_id % 3 = 1), u AS (SELECT * FROM g UNION ALL SELECT doc_id, turn, s, title FROM d WHERE n >= 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS chapter_no, (s // 60) || ':' || ({pad("s % 60")}) AS timestamp, title, CAST(s AS BIGINT) AS seconds FROM u""",
    "video_metadata": """WITH p AS (SELECT page_id AS k, CASE WHEN page_id % 5 = 4 THEN 'https://a.b/' || page_id ELSE 'https://youtu.be/' || lpad(CAST(page_id AS VARCHAR), 11, 'v') || '?t=1' END AS url, CASE WHEN page_id % 5 <> 4 THEN lpad(CAST(page_id AS VARCHAR), 11, 'v') END AS v FROM pages)
SELECT url, CASE WHEN k % 3 < 2 THEN 'i' || k ELSE v END AS id, CASE k % 3 WHEN 0 THEN 'T ' || k WHEN 1 THEN 'i' || k ELSE v END AS title, CASE WHEN k % 3 = 2 THEN 'metadata missing; id from URL' END AS warning FROM p WHERE k % 3 < 2 OR v IS NOT NULL""",
    "best_sources": f"""WITH c AS (SELECT user_id AS doc_id, {pick("event_id // 2", "api", "subtitles", "youtube-transcript-api", "existing", "other", "subtitles-downloaded")} AS kind FROM events WHERE event_id % 4 > 1)
SELECT doc_id, arg_min(kind, CASE kind WHEN 'existing' THEN 1 WHEN 'youtube-transcript-api' THEN 2 WHEN 'subtitles' THEN 3 WHEN 'subtitles-downloaded' THEN 4 WHEN 'api' THEN 5 ELSE 6 END) AS kind FROM c GROUP BY doc_id""",
    "prior_bundles": "WITH b AS (SELECT user_id AS video_id, CAST(event_id AS VARCHAR) AS path, event_id % 3 = 0 AS has_transcript, event_id * 7 % 10 AS modified FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY has_transcript DESC, modified DESC, path) AS n FROM b) SELECT video_id, path, has_transcript, modified FROM r WHERE n = 1",
    "source_hints": rf"""WITH d AS (SELECT doc_id, {pick("doc_id", "@Ann Lee", None, "creator", "Speaker 3", "")} AS creator, {pick("doc_id", "ann lee", "Bob Ray", None)} AS uploader, {pick("doc_id", "Chan | ", "12:30", "Bob Ray", None)} AS channel, {pick("doc_id", None, "Art Ist")} AS artist, {pick("doc_id", None, "@handle", "-")} AS handle FROM documents),
p AS (SELECT *, list_transform([creator, uploader, channel, artist, handle], lambda x: {person("coalesce(x, '')")}) AS ns FROM d), c AS (SELECT *, list_filter(ns[1:4], lambda x: {is_person("x")}) AS ok FROM p),
o AS (SELECT *, list_filter(ok, lambda x, i: list_position(list_transform(ok, lambda y: lower(y)), lower(x)) = i) AS cs FROM c), a AS (SELECT *, coalesce(ok[1], CASE WHEN {is_person("ns[5]")} THEN ns[5] END) AS author, nullif({strip("coalesce(channel, '')")}, '') AS ch, nullif({strip("coalesce(uploader, '')")}, '') AS up, nullif({strip("coalesce(handle, '')")}, '') AS ha FROM o)
SELECT doc_id, author, array_to_string(cs, '|') AS candidates, CAST(CASE WHEN author IS NULL AND len(cs) = 0 AND ch IS NULL AND up IS NULL AND ha IS NULL THEN 0 ELSE 2 + CAST(author IS NOT NULL AS INT) + CAST(len(cs) > 0 AS INT) + CAST(ch IS NOT NULL OR up IS NOT NULL OR ha IS NOT NULL AS INT) END AS BIGINT) AS lines FROM a""",
    "manifest_rows": f"""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS row_no, {label("user_id")} AS chunk_id FROM events)
SELECT '/w/' || user_id || '/manifest_chunk_' || chunk_id || '.tsv' AS doc_id, chunk_id, row_no, 'b' || event_id AS block_file, CASE WHEN user_id % 2 = 0 THEN event_type ELSE 'T "' || event_id || '"' END AS topic, CASE WHEN user_id % 2 = 0 THEN 'Ann Lee; Bob' END AS names, CASE WHEN user_id % 2 = 1 THEN '1:00' WHEN event_id % 3 > 0 THEN '00:10' END AS timestamp_start, CAST(NULL AS VARCHAR) AS case_title FROM e""",
    "merged_manifests": f"""WITH e AS (SELECT user_id AS work_id, {label("(event_id % 60)")} AS c, event_id, 'b' || event_id || chr(9) || CASE WHEN event_id % 10 = 0 THEN 'a b c' WHEN event_id % 7 > 0 THEN event_type ELSE '' END AS r FROM events),
m AS (SELECT work_id, 'block_file' || chr(9) || 'topic' || chr(10) || regexp_replace(string_agg(r, chr(10) ORDER BY length(c), c, event_id), '\\s+$', '') || chr(10) AS tsv FROM e GROUP BY work_id) SELECT work_id, sha256(tsv) AS sha256, CAST(length(tsv) AS BIGINT) AS chars FROM m""",
    "blocks": f"""SELECT '/w/' || doc_id % 10 AS work_id, {label("(doc_id % 60)")} AS chunk_id, doc_id AS block_no, CASE WHEN doc_id % 5 < 4 THEN '00:10' END AS ts_start, CASE WHEN doc_id % 5 < 4 THEN doc_id || ':20' END AS ts_end, CASE WHEN doc_id % 5 < 4 THEN 'Topic ' || doc_id END AS topic, sha256(coalesce(text, 'none')) AS body_sha256 FROM documents WHERE doc_id % 7 < 6""",
    "speaker_maps": "SELECT CAST(conv_id AS VARCHAR) AS work_id, CASE turn % 4 WHEN 0 THEN 'Speaker ' || turn ELSE 'Unmarked lines (part ' || turn || ')' END AS pattern, role AS replacement FROM conversations WHERE turn % 4 IN (0, 2)",
    "prepare_reports": rf"""{PLANS} SELECT work_id, concat_ws(chr(10), '=== NOTES PREPARATION REPORT ===', 'WORK_DIR: ' || work_id, 'Files: 1', 'Total lines: ' || lines, 'Duration estimate: ' || {CLOCK}, 'Content mode: ' || content_mode, 'Speaker stage: ' || speaker_stage || ' (' || {REASON} || ')', 'Prescan limit: ' || prescan || ' lines', '', '=== CHUNK ASSIGNMENTS ===', '',
  '  CHUNK A:', '    file: ' || work_id, '    context_zone: none (first chunk)', '    extraction_zone: lines 1 to ' || lines, '    read_range: lines 1 to ' || lines, '    target_lines: ' || target, '    overlap: ' || overlap, '', '=== TOTAL CHUNKS: 1 ===', '') AS report FROM pl""",
    "prepare_report_fields": f"{PLANS} SELECT work_id AS doc_id, work_id AS work_dir, CAST(1 AS BIGINT) AS files, CAST(lines AS BIGINT) AS total_lines, {CLOCK} AS duration_estimate, CAST(0 AS BIGINT) AS unique_speakers, CAST(1 AS BIGINT) AS total_chunks FROM pl",
    "prescan_texts": rf"""WITH {CONVERSATION_LINES}, q AS (SELECT doc_id, line_no AS hit, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS clue FROM cl WHERE regexp_matches(text, 'Speaker\s+\d+')),
c AS (SELECT cl.doc_id, string_agg(CASE WHEN line_no = hit THEN '>>>' ELSE '   ' END || ' ' || {strip("text")}, chr(10) ORDER BY clue, line_no) AS b FROM q JOIN cl ON cl.doc_id = q.doc_id AND line_no BETWEEN hit - 2 AND hit + 2 WHERE clue <= 15 GROUP BY cl.doc_id),
h AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS a FROM cl WHERE line_no <= 40 GROUP BY doc_id)
SELECT doc_id, regexp_replace(CASE WHEN doc_id LIKE '%3' THEN 'hint one' || chr(10) || 'hint two' || chr(10) || chr(10) ELSE '' END || '=== FIRST LINES ===' || chr(10) || a || chr(10) || chr(10) || '=== SPEAKER HINTS ===' || chr(10) || b, '\s+$', '') || chr(10) AS text FROM h JOIN c USING (doc_id)""",
    "prompt_packs": f"""{PLANS}, pm AS (SELECT *, content_mode AS m, CAST(0 AS BIGINT) AS s, 1 AS c FROM pl), x AS (SELECT *, {MODES} AS mode, CASE m WHEN 'monologue' THEN '7-9' WHEN 'conversation' THEN '7-10' ELSE '8-12' END AS tldr, CASE m WHEN 'monologue' THEN 'лекция' WHEN 'conversation' THEN 'интервью' ELSE 'воркшоп' END AS f FROM pm)
SELECT work_id, 'speaker-identification' AS stage, '' AS chunk_id, '' AS zone, '' AS context, '' AS mode, '' AS min_blocks, '' AS theses, '' AS takeaways, '' AS source, '' AS format FROM x
UNION ALL SELECT work_id, 'extraction', 'A', 'lines 1 to ' || lines, 'none', mode, CAST((SELECT CASE WHEN t.k >= 8000 THEN 4 WHEN t.k >= 4200 THEN 3 WHEN t.k >= 2200 THEN 2 ELSE 1 END FROM (SELECT estimated_tokens AS k FROM s WHERE s.doc_id = x.work_id) t) AS VARCHAR), '5-8', '', '', '' FROM x
UNION ALL SELECT work_id, 'tldr', '', '', '', '', '', '', tldr, '', '' FROM x
UNION ALL SELECT work_id, 'header', '', '', '', '', '', '', '', CASE WHEN work_id LIKE '%1' THEN 'https://www.youtube.com/watch?v=abcdefghijk' ELSE work_id END, f FROM x""",
    "assembled_notes": rf"""WITH d AS (SELECT source, {label("(doc_id % 60)")} AS c, doc_id, regexp_replace('## Topic ' || doc_id || ' (00:10–00:20)' || chr(10) || substr(coalesce(text, ''), 1, 20) || '.', '\n(\s*|---)*$', '') AS b FROM documents), p AS (SELECT source, string_agg(b, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY length(c), c, doc_id) || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS b FROM d GROUP BY source),
n AS (SELECT source AS work_id, CASE WHEN length(source) % 2 = 0 THEN '# Header' || chr(10) || chr(10) || '> x' ELSE '# Title ' || source END || chr(10) || chr(10) || '---' || chr(10) || chr(10) || CASE WHEN source LIKE '%1' THEN '## Коротко о главном' || chr(10) || chr(10) || '1. a' || chr(10) || '2. b' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || b || CASE WHEN source NOT LIKE '%2' THEN '# Appendix' || chr(10) ELSE '' END AS note FROM p)
SELECT work_id, CAST(length(note) AS BIGINT) AS chars, sha256(note) AS sha256 FROM n""",
    "linked_times": rf"""WITH d AS (SELECT doc_id, doc_id || ':' || ({pad("doc_id % 60")}) AS t, CASE WHEN doc_id % 2 = 0 THEN 'https://youtu.be/x?t=' ELSE 'https://a.b/w?v=x&t=' END AS u FROM documents)
SELECT doc_id, '## T ' || CASE WHEN doc_id < 100 THEN '[' || t || '](' || u || (doc_id * 60 + doc_id % 60) || ')' ELSE t END || ' and [1:02:03](' || u || '3723).' || chr(10) || 'plain 2:03' || chr(10) || '## none' || chr(10) || '### third 1:00' AS text FROM d""",
    "json_sinks": "SELECT doc_id, lang FROM documents",
    "stamped_events": "WITH e AS (SELECT event_id, user_id % 7 AS bundle_id FROM events) SELECT bundle_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'r' || event_id WHEN bundle_id < 5 THEN 'run' || bundle_id END AS run_id, CASE WHEN event_id % 4 = 0 THEN 'n' WHEN bundle_id < 5 THEN 'note' || bundle_id END AS note_id FROM e",
    "batch_progress": "SELECT event_type AS state, count(*) AS files FROM events WHERE event_id % 3 <> 1 GROUP BY event_type",
    "latest_stages": "SELECT CAST(user_id AS VARCHAR) AS note_id, 'stage.' || event_type AS event, arg_max(event_id * 7, (ts, event_id * 7)) AS duration_ms FROM events GROUP BY user_id, event_type",
}
