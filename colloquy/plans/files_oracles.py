"""DuckDB SQL of the queries over landed files: the rule, from the rows that the files were written from."""

from __future__ import annotations

BODIES = """f AS (SELECT doc_id // 100 AS part, string_agg(replace(coalesce(text, ''), chr(10), ([chr(10), chr(13) || chr(10), chr(13), chr(11), chr(12), chr(28), chr(133), chr(8232)])[CAST(doc_id % 8 + 1 AS INT)]) || chr(10), '' ORDER BY doc_id, text) AS body FROM documents WHERE doc_id IS NOT NULL GROUP BY ALL)"""

SQL: dict[str, str] = {
    "file_line_ranges": rf"""WITH {BODIES}, s AS (SELECT part, string_split_regex(body, '\r\n|[\n\r\x{{0B}}\x{{0C}}\x{{1C}}\x{{1D}}\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]') AS p FROM f), c AS (SELECT part, p[:len(p) - 1] AS ls FROM s)
SELECT part, CAST(len(ls) AS BIGINT) AS lines, CAST(list_sum(list_transform(ls, lambda x, i: length(x) * i)) AS BIGINT) AS weighed, ls[len(ls)] AS last_line FROM c""",
    "whole_files": f"WITH {BODIES} SELECT part, CAST(strlen(body) AS BIGINT) AS bytes, CAST(length(body) AS BIGINT) AS chars, sha256(body) AS sha256 FROM f",
    "copied_files": f"WITH {BODIES} SELECT part, CAST(strlen(body) AS BIGINT) AS bytes, sha256(body) AS sha256, sha256(body) AS copy_sha256 FROM f",
    "manifest_cells": r"""WITH d AS (SELECT doc_id // 100 AS part, doc_id, doc_id % 5 AS k, coalesce(text, '') || (['', chr(9) || 'a', chr(10) || '"b"' || chr(10), chr(13) || chr(10) || chr(10), '"'])[CAST(doc_id % 5 + 1 AS INT)] AS t FROM documents WHERE doc_id IS NOT NULL)
SELECT CAST(part AS VARCHAR) AS chunk_id, row_number() OVER (PARTITION BY part ORDER BY doc_id) AS row_no, CASE k WHEN 0 THEN 'b' WHEN 1 THEN 'b' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS block_file,
CASE k WHEN 0 THEN NULL WHEN 1 THEN 'last' ELSE 'c"' || doc_id END AS topic, CASE WHEN k > 0 AND trim(t) <> '' THEN length(t) END AS chars, CASE WHEN k > 0 AND trim(t) <> '' THEN sha256(t) END AS sha256 FROM d""",
    "natural_names": """WITH d AS (SELECT doc_id // 100 AS part, doc_id AS k, (['.n', 'lesson', 'lesson', 'lesson', 'lessonb', 'lesson-'])[CAST(doc_id % 6 + 1 AS INT)] || (['', '00'])[CAST((doc_id // 6) % 2 + 1 AS INT)] || doc_id || (['', '~', '', '.tar.gz', '.md', ''])[CAST(doc_id % 6 + 1 AS INT)] AS name FROM documents WHERE doc_id IS NOT NULL)
SELECT part, name, row_number() OVER (PARTITION BY part ORDER BY CASE k % 6 WHEN 0 THEN 0 WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE 1 END, k, name) AS rank FROM d""",
    "published_notes": """WITH d AS (SELECT doc_id, coalesce(source, '') AS title, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
a AS (SELECT min((doc_id, title)) AS r, sha256(text) AS sha256 FROM d GROUP BY ALL), b AS (SELECT min((doc_id, title)) AS r, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS sha256 FROM d GROUP BY ALL),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE sha256 NOT IN (SELECT sha256 FROM a)) SELECT r[1] AS doc_id, r[2] AS title, sha256 FROM u""",
    "html_notes": r"""WITH d AS (SELECT doc_id, chr(10) AS n, doc_id % 3 AS p, list_transform(string_split(regexp_replace(coalesce(text, ''), '[^\p{L}\n .,]', ' ', 'g'), chr(10)), lambda x: trim(x)) AS ls FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT *, list_filter(string_split_regex(array_to_string(ls, chr(10)), '\n{2,}'), lambda x: trim(x, chr(10)) <> '') AS ps FROM d),
h AS (SELECT doc_id, '<!DOCTYPE html>' || n || '<html><head><meta charset="utf-8"><title>Note ' || doc_id || '</title></head><body>' || n || '<nav id="TOC"><ul><li><a href="#note-' || doc_id || '">Note ' || doc_id || '</a><ul><li><a href="#part-' || p || '">Part &amp; ' || p || '</a></li><li><a href="#part-' || p || '--2">Part &amp; ' || p || '</a></li></ul></li></ul></nav>' || n
  || '<h1 id="note-' || doc_id || '">Note ' || doc_id || '</h1>' || n || '<h2 id="part-' || p || '">Part &amp; ' || p || '</h2>' || n || array_to_string(list_transform(ps, lambda x: '<p>' || trim(x, chr(10)) || '</p>' || chr(10)), '')
  || '<ul><li>one<ul><li>two <em>' || doc_id || '</em></li></ul><ol><li>three</li></ol></li><li>four</li></ul>' || n || '<h2 id="part-' || p || '--2">Part &amp; ' || p || '</h2>' || n || '<table><thead><tr><th>x</th><th>y</th></tr></thead><tbody><tr><td>' || doc_id || '</td><td><code>2</code></td></tr></tbody></table>' || n || '</body></html>' || n AS html FROM b)
SELECT doc_id, 'Note ' || doc_id AS title, CAST(length(html) AS BIGINT) AS chars, sha256(html) AS sha256 FROM h""",
}
