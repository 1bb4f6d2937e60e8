"""DuckDB SQL for the queries that SQL can express, over the whole tables."""

from .url_filter import PATTERNS

op1_substring_dedup = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 49), ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50)),
first AS (SELECT t, min(doc_id) AS d FROM win GROUP BY t),
hit AS (SELECT DISTINCT doc_id, p + o AS pos FROM (SELECT win.doc_id, p, unnest(range(0, 50)) AS o FROM win JOIN first USING (t) WHERE first.d < win.doc_id)),
gone AS (SELECT doc_id, list(pos) AS ats FROM hit GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(ws) AS n, coalesce(len(ats), 0) AS r,
  CASE WHEN ats IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(ats, x[2])), lambda x: x[1]), ' ') END AS k
  FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(k) AS kept_sha256 FROM kept
"""

op6_mixing = r"""
WITH d AS (SELECT doc_id, source, md5('mix' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s),
x AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1]::BIGINT AS wt, ss * 3 AS most FROM w),
y AS (SELECT *, row_number() OVER o AS rank,
  (sum(ss) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
  (sum(wt) OVER () - coalesce(sum(wt) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS share
  FROM x WINDOW o AS (ORDER BY most / wt, place)),
f AS (SELECT rank AS frank, rest AS frest, share AS fshare FROM y WHERE rest * wt <= most * share ORDER BY rank LIMIT 1),
t AS (SELECT source, ss, CASE WHEN rank >= frank THEN (wt * frest)::DOUBLE / fshare ELSE most::DOUBLE END AS target FROM y, f),
p AS (SELECT doc_id, size, ss, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, floor(target + 0.5)::BIGINT AS budget FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN ss > 0 THEN budget // ss ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, ss AS source_size, target, (epochs * size + least(greatest(budget - epochs * ss - before, 0), size))::BIGINT AS taken FROM e
"""

def _fires(rule):
    subject = {"host": "host", "page": "host || path", "url": "site"}[rule.scope]
    return f"regexp_matches({subject}, '{rule.regex}')"


op8_url_filter = r"""
WITH a AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS after FROM pages),
b AS (SELECT page_id, translate(regexp_extract(coalesce(after, ''), '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(after, ''), '(?s)^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(after, ''), '(?s)^[^/?#]*([^#]*)', 1) AS rest FROM a),
c AS (SELECT *, host || rest AS site, CASE
  WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
  WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
  WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM b)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN """ + " OR ".join(map(_fires, PATTERNS)) + " THEN 'block' ELSE 'allow' END AS verdict FROM c"

_ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"\'\']?\\x20*[:=]\\x20*[\"\'\']?([A-Za-z0-9+/_.=-]+)"
_KINDS = (("assign", 0, _ASSIGN, f"length(regexp_extract(h, '{_ASSIGN}', 1)) >= 6"), ("access", 1, "AKIA[A-Z0-9]+", "length(h) >= 20"), ("hex", 2, "[0-9a-f]+", "length(h) >= 24"))
_MATCHES = " UNION ALL ".join(
    f"""SELECT doc_id, start, {k} AS kind, start + length(h) AS stop, '{name}' AS name FROM (
  SELECT doc_id, hits[i] AS h, list_sum(list_transform(gaps[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0)::BIGINT AS start FROM (
    SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM documents WHERE regexp_matches(text, '{quick}')))) WHERE {ok}"""
    for (name, k, pattern, ok), quick in zip(_KINDS, (_ASSIGN, "AKIA[A-Z0-9]{16}", "[0-9a-f]{24}"), strict=True)
)
secrets_base = f"""
WITH m AS ({_MATCHES}),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS s FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(s, '')) AS base_sha256 FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""

quality_counts = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (SELECT doc_id, p, [ws[p], ws[p + 1], ws[p + 2]] AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) >= 3)),
r AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
c AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM (SELECT doc_id, p, unnest(range(0, 3)) AS o FROM r) GROUP BY doc_id),
q AS (SELECT l.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM l LEFT JOIN c ON c.doc_id = l.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q
"""

media_payload = """
WITH b AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
p AS (SELECT *, CASE WHEN n = 0 THEN 64 ELSE (n + 63) // 64 * 64 END AS m FROM b)
SELECT doc_id, n AS n_bytes, m::BIGINT AS payload_bytes, sha256(encode(text) || repeat('\\x00'::BLOB, m - n)) AS payload_sha256 FROM p
"""
