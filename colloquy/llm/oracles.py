"""DuckDB SQL for the queries that SQL can express."""

OP1_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex, html FROM p),
l AS (SELECT html, max(page_id) AS last_id FROM h GROUP BY html)
SELECT h.page_id, h.payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h.hex, CAST((i // 4) * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN h.page_id = l.last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN h.page_id <> l.last_id THEN l.last_id END AS refers_to
FROM h JOIN l USING (html)
"""

OP4_NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, hash(unnest(sh)) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n_shingles + nb.n_shingles - k)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM n UNION SELECT r.node, g.b FROM r JOIN g ON g.a = r.reached),
m AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT n.doc_id, n.n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m ON m.node = n.doc_id
"""

OP7_CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
f AS (
  SELECT *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS chars,
    row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

OP12_COLLOCATIONS = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
s AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE k > 1 AND f >= 30),
t AS (SELECT lang, phrase, a, unnest(range(1, k)) AS cut, ws FROM s),
u AS (
  SELECT t.lang, t.phrase, t.a, t.cut, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * t.a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM t JOIN c x ON x.lang = t.lang AND x.phrase = array_to_string(ws[1:cut], ' ') JOIN c y ON y.lang = t.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT s.lang, s.a AS longer, unnest(flatten(list_transform(range(2, s.k), lambda m: list_transform(range(1, s.k - m + 2), lambda q: array_to_string(ws[q:q + m - 1], ' '))))) AS phrase FROM s WHERE s.k > 2),
m AS (SELECT lang, phrase, max(longer) AS longer FROM i GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN m USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z) JOIN n USING (lang) WHERE rank <= 2000
"""

#: Canonical links and refreshes are read by patterns here, for heads in plain markup with absolute targets.
OP13_URL_FILTERS = r"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
e AS (
  SELECT url, unnest(regexp_extract_all(html, '<link rel="canonical" href="(https?://[^"]*)"', 1) || regexp_extract_all(html, '<meta http-equiv="refresh" content="[0-9]+; url=(https?://[^"]*)"', 1)) AS target
  FROM pages WHERE contains(url, '://')),
urls AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT target FROM e) WHERE url IS NOT NULL),
r AS (SELECT url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM urls),
k AS (
  SELECT url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM r),
n AS (
  SELECT *, CASE WHEN contains(url, '://') THEN translate(substr(url, 1, instr(url, '://') - 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' || host || CASE WHEN starts_with(tail, '/') THEN '' ELSE '/' END || tail END AS node FROM k),
d AS (SELECT n.url, arg_max(h || p, (length(h) + length(p), length(h))) AS rule, arg_max(verdict, (length(h) + length(p), length(h))) AS own
  FROM n JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n.url),
g AS (SELECT DISTINCT a.node AS a, b.node AS b FROM e JOIN n a ON a.url = e.url JOIN n b ON b.url = e.target),
w AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
c AS (SELECT a AS node, a AS reached FROM w UNION SELECT c.node, w.b FROM c JOIN w ON w.a = c.reached),
dn AS (SELECT node, arg_max(verdict, (length(h) + length(p), length(h))) AS own
  FROM n JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(CASE WHEN path = '' THEN '/' ELSE path END, p) GROUP BY node),
v AS (SELECT c.node, min(dn.own) AS class_verdict FROM c JOIN dn ON dn.node = c.reached GROUP BY c.node)
SELECT page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, d.rule, coalesce(d.own, v.class_verdict, 'allow') AS verdict,
  CASE WHEN d.own IS NOT NULL THEN 'rule' WHEN v.class_verdict IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM pages LEFT JOIN n ON n.url = pages.url LEFT JOIN d ON d.url = pages.url LEFT JOIN v ON v.node = n.node
"""

SQL = {"op1_warc": OP1_WARC, "op4_near_duplicates": OP4_NEAR_DUPLICATES, "op7_chat": OP7_CHAT, "op12_collocations": OP12_COLLOCATIONS, "op13_url_filters": OP13_URL_FILTERS}
