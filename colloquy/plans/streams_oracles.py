"""DuckDB SQL of the queries that run streams: the rule over the whole table."""

from __future__ import annotations

SQL: dict[str, str] = {
    "merged_runs": """WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN 'run.started' WHEN event_id % 20 = 1 THEN 'run.note' ELSE 'run.finished' END AS event, CAST(event_id // 2 AS VARCHAR) AS run_id, CAST(user_id AS VARCHAR) AS note_id, CASE WHEN event_id % 3 = 0 THEN 'assembled' ELSE 'finished' END AS status FROM events)
SELECT run_id, arg_min(note_id, (ts, note_id)) FILTER (event = 'run.started') AS note_id, min(ts) FILTER (event = 'run.started') AS started_at, min(ts) FILTER (event = 'run.finished') AS finished_at,
  CASE WHEN count(*) FILTER (event = 'run.finished') > 0 THEN arg_min(status, (ts, status)) FILTER (event = 'run.finished') WHEN count(*) FILTER (event = 'run.started') > 0 THEN 'running' ELSE 'unknown' END AS status,
  arg_max(event, (ts, event)) AS last_event, max(ts) AS last_at, count(*) AS events FROM e GROUP BY run_id""",
    "resumed_chunks": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
c AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN text || chr(10) || 'changed' ELSE text END AS text, doc_id % 8 = 0 AS changed FROM d)
SELECT doc_id, substr(sha256(text), 1, 12) AS fingerprint, CASE WHEN changed AND (doc_id + 4) % 5 > (doc_id + 2) % 5 THEN 2 ELSE 1 END AS times, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CAST(length(text) AS BIGINT) AS chars FROM c""",
}
