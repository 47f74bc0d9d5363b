"""DuckDB SQL for the operators that SQL can express, over whole tables."""



def _resolved(links: str, name: str) -> str:
    """CTEs that end in ``name``: ``links (source, onto, t)`` with ``url``, the target t of a link as an absolute address, resolved against onto; null if it is none."""
    return rf"""{name}_parts AS (
  SELECT *, trim(replace(t, '&amp;', '&')) AS tt, regexp_extract(onto, '^([^:/?#]*)://', 1) AS scheme, regexp_extract(onto, '^([^:/?#]*://[^/?#]*)', 1) AS site,
         regexp_extract(onto, '://[^/?#]*([^?#]*)', 1) AS path
  FROM {links}
),
{name}_whole AS (
  SELECT source, onto, t, CASE WHEN regexp_matches(tt, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN tt
    WHEN tt = '' OR tt[1] = '#' OR regexp_matches(tt, '^[A-Za-z][A-Za-z0-9+.-]*:') OR site = '' THEN NULL
    WHEN starts_with(tt, '//') THEN scheme || ':' || tt
    WHEN tt[1] = '/' THEN site || tt
    WHEN tt[1] = '?' THEN site || path || tt
    ELSE site || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || tt END AS whole
  FROM {name}_parts
),
{name}_cut AS (
  SELECT source, onto, t, regexp_extract(whole, '^([^:/?#]*://[^/?#]*)', 1) AS site, regexp_extract(whole, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(whole, '^[^?#]*(.*)$', 1) AS tail,
         list_transform(string_split(regexp_extract(whole, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: [x]) AS names
  FROM {name}_whole WHERE whole IS NOT NULL
),
{name} AS (
  SELECT source, onto, t, site || CASE WHEN NOT regexp_matches(path, '/\.\.?(/|$)') THEN path
    ELSE array_to_string(list_reduce(names, lambda a, x: CASE x[1] WHEN '..' THEN a[1:greatest(1, len(a) - 1)] WHEN '.' THEN a ELSE list_concat(a, x) END, CAST([] AS VARCHAR[])), '/')
      || CASE WHEN names[-1][1] IN ('.', '..') THEN '/' ELSE '' END END || tail AS url
  FROM {name}_cut
)"""


OP1 = r"""
WITH RECURSIVE rules(rule, verdict) AS (
  VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')
),
split AS (SELECT rule, verdict, left(rule, strpos(rule, '/') - 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM rules),
linked AS (
  SELECT url AS source, coalesce(regexp_extract(html, '(?i)<base\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1), '') AS base,
    list_filter(regexp_extract_all(html, '(?i)<link\b[^>]*>'), lambda x: regexp_matches(x, '(?i)[\s"''/]rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|''(?:[^'']*\s)?canonical(?:\s[^'']*)?''|canonical[\s/>])')) AS links,
    regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>') AS metas
  FROM (SELECT url, regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g') AS html FROM pages) WHERE url IS NOT NULL AND html IS NOT NULL
),
bases AS (SELECT DISTINCT source, source AS onto, base AS t FROM linked WHERE base <> ''),
""" + _resolved("bases", "based") + r""",
aimed AS (
  SELECT x.source, coalesce(b.url, x.source) AS onto, x.t
  FROM (
    SELECT source, base, regexp_extract(x, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM (SELECT source, base, unnest(links) AS x FROM linked)
    UNION ALL SELECT source, base, regexp_extract(x, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM (SELECT source, base, unnest(metas) AS x FROM linked)) x
  LEFT JOIN based b ON b.source = x.source AND b.t = x.base
  WHERE x.t <> ''
),
""" + _resolved("aimed", "targets") + r""",
urls AS (SELECT page_id, url, CAST(NULL AS VARCHAR) AS source FROM pages UNION ALL SELECT NULL, url, source FROM targets WHERE url IS NOT NULL),
parts AS (
  SELECT page_id, source, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '://[^?#]*(\?[^#]*)', 1), '') AS query
  FROM urls
),
keyed AS (
  SELECT page_id, source, url, host, path, CASE WHEN host <> '' THEN regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '') || query END AS key,
    (SELECT max_by(s.rule, length(s.rule)) FROM split s WHERE (host = s.rule_host OR ends_with(host, '.' || s.rule_host)) AND starts_with(path, s.rule_path)) AS rule
  FROM parts
),
judged AS (SELECT k.*, r.verdict AS own FROM keyed k LEFT JOIN rules r ON r.rule = k.rule),
pairs AS (SELECT DISTINCT a.key AS u, b.key AS v FROM judged b JOIN judged a ON a.url = b.source AND a.page_id IS NOT NULL WHERE b.source IS NOT NULL AND a.key <> b.key),
both_ways AS (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs),
reach(node, seen) AS (SELECT u, u FROM both_ways UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON b.u = r.seen),
blocked AS (
  SELECT DISTINCT key AS node FROM judged WHERE own = 'block' AND key IS NOT NULL
  UNION SELECT r.node FROM reach r JOIN judged j ON j.key = r.seen WHERE j.own = 'block'
)
SELECT j.page_id, j.host, j.path, j.rule,
  coalesce(j.own, CASE WHEN b.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  (j.rule IS NULL AND b.node IS NOT NULL) AS inherited
FROM judged j LEFT JOIN blocked b ON b.node = j.key WHERE j.source IS NULL
"""

OP4 = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, text FROM conversations),
said AS (
  SELECT r, conv_id, turn, n, length(regexp_replace(regexp_extract(line, '^([ \t]*>)*'), '[^>]', '', 'g')) AS level,
         regexp_replace(line, '^([ \t]*>)+[ \t]?', '') AS said
  FROM (SELECT r, conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM m)
),
ranked_lines AS (
  SELECT *, n - row_number() OVER (PARTITION BY r, level ORDER BY n) AS run,
    trim(regexp_replace(translate(said, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+', ' ', 'g')) AS plain FROM said
),
-- Lines of one level behind each other are a passage; the own lines of a message count as one.
spoken AS (
  SELECT r, conv_id, turn, level, CASE WHEN level > 0 THEN run ELSE 0 END AS run, list(plain ORDER BY n) AS ls, string_split(string_agg(plain, ' ' ORDER BY n), ' ') AS ws
  FROM ranked_lines WHERE plain <> '' GROUP BY ALL
),
-- Rows that repeat a turn count as one message, passage by passage in their order.
numbered AS (SELECT *, row_number() OVER (PARTITION BY r, level > 0 ORDER BY (SELECT min(n) FROM ranked_lines x WHERE x.r = spoken.r AND x.level = spoken.level AND x.run = spoken.run)) AS passage FROM spoken),
units AS (
  SELECT DISTINCT conv_id, turn, level, passage, unnest(list_concat(ls, CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS unit, r
  FROM numbered
),
first AS (SELECT conv_id, unit, min(turn) AS origin FROM units WHERE level = 0 GROUP BY ALL),
hits AS (SELECT q.conv_id, q.turn, q.level, q.passage, f.origin FROM units q JOIN first f ON q.conv_id = f.conv_id AND q.unit = f.unit WHERE q.level > 0 AND f.origin < q.turn),
counted AS (SELECT conv_id, turn, count(DISTINCT passage) AS n_linked FROM hits GROUP BY ALL),
found AS (SELECT conv_id, turn, level, origin, count(*) AS n FROM hits GROUP BY ALL),
ranked AS (SELECT f.*, c.n_linked, row_number() OVER (PARTITION BY f.conv_id, f.turn ORDER BY level, n DESC, origin DESC) AS k FROM found f JOIN counted c ON c.conv_id = f.conv_id AND c.turn = f.turn),
links AS (SELECT conv_id, turn, origin AS parent, n_linked FROM ranked WHERE k = 1),
up(conv_id, turn, root, depth) AS (
  SELECT conv_id, turn, parent, 1 FROM links
  UNION ALL SELECT u.conv_id, u.turn, l.parent, u.depth + 1 FROM up u JOIN links l ON l.conv_id = u.conv_id AND l.turn = u.root
),
roots AS (SELECT conv_id, turn, max(depth) AS depth, min(root) AS root FROM up GROUP BY ALL),
bodies AS (SELECT r, regexp_replace(regexp_replace(coalesce(string_agg(said, chr(10) ORDER BY n) FILTER (WHERE level = 0), ''), '^[ \t-\r]+', ''), '[ \t-\r]+$', '') AS body FROM said GROUP BY r),
quoted AS (SELECT r, count(*) AS n FROM spoken WHERE level > 0 GROUP BY r),
rows_ AS (
  SELECT m.conv_id, m.turn, m.role, b.body, coalesce(q.n, 0) AS n_quoted, coalesce(l.n_linked, 0) AS n_linked, l.parent, coalesce(x.root, m.turn) AS root, coalesce(x.depth, 0) AS depth
  FROM m JOIN bodies b USING (r) LEFT JOIN quoted q USING (r)
  LEFT JOIN links l ON l.conv_id = m.conv_id AND l.turn = m.turn LEFT JOIN roots x ON x.conv_id = m.conv_id AND x.turn = m.turn
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY root NULLS FIRST, depth, turn NULLS FIRST, role NULLS FIRST, body) - 1 AS position,
  turn, role, body, parent AS parent_turn, root AS root_turn, CAST(depth AS BIGINT) AS depth, n_quoted, CAST(n_linked AS BIGINT) AS n_linked
FROM rows_
"""

OP5 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
wins AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS p FROM d WHERE len(w) >= 20)),
dups AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM wins) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p + o AS p FROM dups, (SELECT unnest(generate_series(0, 19)) AS o)),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""

OP9 = r"""
WITH low(k, id, text) AS (
  SELECT 'd', CAST(doc_id AS VARCHAR), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM documents
  UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
),
t AS (SELECT k, id, list_filter(regexp_split_to_array(text, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM low),
items AS (SELECT id, w, least(10, len(w)) AS size FROM t WHERE k = 'b' AND len(w) > 0),
phrases AS (SELECT DISTINCT id AS item, size, array_to_string(w[p:p + size - 1], ' ') AS s FROM (SELECT id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p FROM items)),
sizes AS (SELECT DISTINCT size FROM items),
wins AS (SELECT id, size, p, array_to_string(w[p:p + size - 1], ' ') AS s FROM (SELECT t.id, t.w, z.size, unnest(generate_series(1, len(t.w) - z.size + 1)) AS p FROM t, sizes z WHERE t.k = 'd' AND len(t.w) >= z.size)),
found AS (SELECT w.id, w.size, w.p, f.item FROM wins w JOIN phrases f ON f.size = w.size AND f.s = w.s),
hit AS (SELECT id, count(DISTINCT q) AS n FROM (SELECT DISTINCT id, unnest(generate_series(p, p + size - 1)) AS q FROM found) GROUP BY id),
named AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT id, item FROM found) GROUP BY id)
SELECT CAST(t.id AS BIGINT) AS doc_id, CAST(len(t.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items, sha256(coalesce(n.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM t LEFT JOIN hit h ON h.id = t.id LEFT JOIN named n ON n.id = t.id WHERE t.k = 'd'
"""
