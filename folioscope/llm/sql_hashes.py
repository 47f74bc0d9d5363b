"""DuckDB SQL for fingerprints: XXH64 in whole numbers, SimHash groups and one-permutation MinHash.

Numbers are UHUGEINT below 2 ** 64. A rotation by r is the remainder of x 2 ** r
by 2 ** 64 - 1, so each step names its number once.
"""

from __future__ import annotations

#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
SEED = 42
_M = 1 << 64


def _n(x: int) -> str:
    return f"{x}::UHUGEINT"


def _times(x: str, by: int) -> str:
    return f"(({x}) * {_n(by)} % {_n(_M)})"


def _plus(x: str, y: str) -> str:
    return f"((({x}) + ({y})) % {_n(_M)})"


def _turned(x: str, bits: int) -> str:
    return f"(({x}) * {_n(1 << bits)} % {_n(_M - 1)})"


def _round(acc: str, word: str) -> str:
    return _times(_turned(_plus(acc, _times(word, P2)), 31), P1)


def _eight(h: str, word: str) -> str:
    return _plus(_times(_turned(f"xor({h}, {_round(_n(0), word)})", 27), P1), _n(P4))


def _merged(h: str, lane: str) -> str:
    return _plus(_times(f"xor({h}, {_round(_n(0), lane)})", P1), _n(P4))


def _mixed(source: str, name: str, h: str = "h", keep: str = "*") -> str:
    """CTEs that end in ``name``: ``source`` with the last mixing of ``h`` as ``h``."""
    rest = "EXCLUDE (h)"
    return f"""
{name}_1 AS (SELECT {keep} {rest}, {_times(f"xor({h}, {h} // {_n(1 << 33)})", P2)} AS h FROM {source}),
{name}_2 AS (SELECT {keep} {rest}, {_times(f"xor(h, h // {_n(1 << 29)})", P3)} AS h FROM {name}_1),
{name} AS (SELECT {keep} {rest}, xor(h, h // {_n(1 << 32)}) AS h FROM {name}_2)"""


def xxh64(strings: str) -> str:
    """CTEs that end in ``hashed (s, h)`` for the distinct ``s`` of the table ``strings``."""
    byte = lambda at: f"x[{at} + 1:{at} + 2]"
    number = lambda at, size: "CAST('0x' || " + " || ".join(byte(f"({at}) * 2 + {2 * k}") for k in reversed(range(size))) + " AS UBIGINT)::UHUGEINT"
    lane = lambda j, start: f"list_reduce(list_transform(range(0, n // 32), lambda i: w8[4 * i + {j + 1}]), lambda a, w: {_round('a', 'w')}, {_n(start % _M)})"
    first = [lane(j, s) for j, s in enumerate((SEED + P1 + P2, SEED + P2, SEED, SEED - P1))]
    joined = _plus(_plus(_turned("v1", 1), _turned("v2", 7)), _plus(_turned("v3", 12), _turned("v4", 18)))
    for k in range(1, 5):
        joined = _merged(joined, f"v{k}")
    four = _plus(_times(_turned(f"xor(h, {_times(number('n // 8 * 8', 4), P1)})", 23), P2), _n(P3))
    one = _times(_turned(f"xor(a, {_times('b', P5)})", 11), P1)
    return f"""
bytes AS (SELECT s, strlen(s) AS n, hex(encode(s)) AS x FROM (SELECT DISTINCT s FROM {strings})),
words8 AS (SELECT s, n, x, list_transform(range(0, n // 8), lambda i: {number("i * 8", 8)}) AS w8 FROM bytes),
lanes AS (SELECT *, {", ".join(f"CASE WHEN n >= 32 THEN {e} END AS v{k}" for k, e in enumerate(first, 1))} FROM words8),
long_ AS (SELECT s, n, x, w8, {_plus(f"CASE WHEN n >= 32 THEN {joined} ELSE {_n(SEED + P5)} END", "n::UHUGEINT")} AS h FROM lanes),
eights AS (SELECT s, n, x, list_reduce(w8[n // 32 * 4 + 1:], lambda a, w: {_eight("a", "w")}, h) AS h FROM long_),
fours AS (SELECT s, n, x, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM eights),
ones AS (SELECT s, list_reduce(list_transform(range(n // 4 * 4, n), lambda i: {number("i", 1)}), lambda a, b: {one}, h) AS h FROM fours),
{_mixed("ones", "hashed")}"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({_LOWER.format(text)}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def simhash(shingle: int = 4, distance: int = 4) -> str:
    bits = " + ".join(f"CASE WHEN 2 * sum((u >> {b}) & 1) > count(*) THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(64))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= {shingle} THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - {shingle - 1}), lambda i: array_to_string(w[i:i + {shingle - 1}], ' ')) END) AS s FROM d),
{xxh64("shingles")},
prints AS (SELECT doc_id, CAST({bits} AS UBIGINT) AS f FROM (SELECT doc_id, CAST(h AS UBIGINT) AS u FROM shingles JOIN hashed USING (s)) GROUP BY doc_id),
fp AS (SELECT d.doc_id, coalesce(p.f, 0::UBIGINT) AS f FROM d LEFT JOIN prints p ON p.doc_id = d.doc_id),
kinds AS (SELECT f, min(doc_id) AS least FROM fp GROUP BY f),
linked AS (SELECT a.f AS a, b.f AS b FROM kinds a JOIN kinds b ON bit_count(xor(a.f, b.f)) <= {distance}),
reach(f, g) AS (SELECT f, f FROM kinds UNION SELECT r.f, l.b FROM reach r JOIN linked l ON l.a = r.g),
named AS (SELECT r.f, min(k.least) AS component_id FROM reach r JOIN kinds k ON k.f = r.g GROUP BY r.f)
SELECT fp.doc_id, lpad(lower(hex(fp.f)), 16, '0') AS fingerprint, n.component_id FROM fp JOIN named n ON n.f = fp.f
"""


def minhash(words: int = 5, probes: int = 24, prime: int = 65537) -> str:
    """256 bins of 4 bits, of each document's text and of its edited text."""
    steps, last = "chain_0 AS (SELECT x, 42::UHUGEINT AS h FROM (SELECT DISTINCT x FROM shingles))", "chain_0"
    for k in range(1, words + 1):
        steps += f""",
tied_{k} AS (SELECT x, h AS old, {_eight(_plus("h", _n(P5 + 8)), f"x[{k}]")} AS h FROM {last}),
{_mixed(f"tied_{k}", f"turned_{k}")},
chain_{k} AS (SELECT x, coalesce(h, old) AS h FROM turned_{k})"""
        last = f"chain_{k}"
    like = lambda a, b, d: f"CASE WHEN {a} = '' AND {b} = '' THEN 1 WHEN {a} = '' OR {b} = '' THEN 0 ELSE greatest(0::DOUBLE, least(1::DOUBLE, (1 - {d} / 256::DOUBLE - 0.0625::DOUBLE) / (1 - 0.0625::DOUBLE))) END"
    differ = lambda a, b: f"len(list_filter(range(1, 257), lambda i: {a}[i] <> {b}[i]))"
    return f"""
WITH own AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
followed AS (
  SELECT doc_id, text, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS next_id,
    coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM own),
edits AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM followed),
texts AS (SELECT doc_id, 0 AS kind, {_words("text")} AS w FROM edits UNION ALL SELECT doc_id, 1, {_words("edited")} FROM edits),
said AS (SELECT doc_id, kind, unnest(w) AS s, generate_subscripts(w, 1) AS p FROM texts),
{xxh64("said")},
numbers AS (SELECT doc_id, kind, list(h ORDER BY p) AS hs FROM said JOIN hashed USING (s) GROUP BY doc_id, kind),
shingles AS (
  SELECT doc_id, kind, unnest(CASE WHEN len(hs) <= {words} THEN [hs] ELSE list_transform(generate_series(1, len(hs) - {words - 1}), lambda i: hs[i:i + {words - 1}]) END) AS x FROM numbers),
{steps},
filled AS (
  SELECT doc_id, kind, CAST((h // {_n(1 << 56)} + 128) % 256 AS INTEGER) AS j, CAST(min(h % {_n(1 << 56)}) % 16 AS INTEGER) AS v
  FROM shingles JOIN {last} USING (x) GROUP BY ALL),
bins AS (SELECT n.doc_id, n.kind, i.i, f.v FROM numbers n CROSS JOIN (SELECT unnest(range(256)) AS i) i LEFT JOIN filled f ON f.doc_id = n.doc_id AND f.kind = n.kind AND f.j = i.i),
probes AS (SELECT i, k, (i * (1 + (k * 25173 + 13849) % {prime - 1}) + (k * 40503 + 7919) % {prime}) % {prime} % 256 AS j FROM (SELECT unnest(range(256)) AS i), (SELECT unnest(range(1, {probes + 1})) AS k)),
probed AS (
  SELECT b.doc_id, b.kind, b.i, arg_min(f.v, p.k) AS v FROM bins b JOIN probes p ON p.i = b.i JOIN filled f ON f.doc_id = b.doc_id AND f.kind = b.kind AND f.j = p.j
  WHERE b.v IS NULL GROUP BY ALL),
left_over AS (SELECT b.doc_id, b.kind, b.i FROM bins b ANTI JOIN probed p ON p.doc_id = b.doc_id AND p.kind = b.kind AND p.i = b.i WHERE b.v IS NULL),
walked AS (
  SELECT o.doc_id, o.kind, o.i, arg_min(f.v, (f.j * ((o.i * 40503 + 25173) % {prime} * 2 + 1) + (o.i * 30803 + 13849) % {prime}) % 256) AS v
  FROM left_over o JOIN filled f ON f.doc_id = o.doc_id AND f.kind = o.kind GROUP BY ALL),
dense AS (SELECT * FROM bins WHERE v IS NOT NULL UNION ALL SELECT * FROM probed UNION ALL SELECT * FROM walked),
prints AS (SELECT doc_id, kind, string_agg('0123456789abcdef'[v + 1], '' ORDER BY i) AS f FROM dense GROUP BY doc_id, kind),
rows_ AS (
  SELECT e.doc_id, length(e.text) AS n_chars, sha256(e.edited) AS edited_sha256, coalesce(a.f, '') AS fingerprint, coalesce(b.f, '') AS edited_fingerprint, coalesce(c.f, '') AS next_fingerprint
  FROM edits e LEFT JOIN prints a ON a.doc_id = e.doc_id AND a.kind = 0 LEFT JOIN prints b ON b.doc_id = e.doc_id AND b.kind = 1 LEFT JOIN prints c ON c.doc_id = e.next_id AND c.kind = 0)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  {like("fingerprint", "edited_fingerprint", differ("fingerprint", "edited_fingerprint"))} AS near_edited,
  {like("fingerprint", "next_fingerprint", differ("fingerprint", "next_fingerprint"))} AS near_next
FROM rows_
"""


def crc32(strings: str) -> str:
    """CTEs that end in ``checked (s, crc)`` for the distinct ``s`` of the table ``strings``: four bits at a time, the lower four of a byte first."""
    four = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        four.append(x)
    step = f"xor(a >> 4, [{', '.join(f'{x}::BIGINT' for x in four)}][xor(a, b) % 16 + 1])"
    return f"""
spelt AS (SELECT s, hex(encode(s)) AS x FROM (SELECT DISTINCT s FROM {strings})),
digits AS (SELECT s, list_transform(range(0, len(x)), lambda i: (strpos('0123456789ABCDEF', x[i // 2 * 2 + 2 - i % 2]) - 1)::BIGINT) AS items FROM spelt),
checked AS (SELECT s, xor(list_reduce(items, lambda a, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM digits)"""


def resampling(percent: int = 5, least: int = 20, buckets: int = 10_000, seed: int = 42) -> str:
    words = f"list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
WITH t AS (
  SELECT 'd' AS k, doc_id AS id, row_number() OVER () AS r, {words} AS w FROM documents
  UNION ALL SELECT 'b', NULL, row_number() OVER (), {words} FROM benchmark),
ones AS (SELECT k, r, unnest(w) AS a, generate_subscripts(w, 1) AS p FROM t),
runs AS (SELECT k, r, a, lead(a) OVER (PARTITION BY k, r ORDER BY p) AS b, lead(a, 2) OVER (PARTITION BY k, r ORDER BY p) AS c FROM ones),
said AS MATERIALIZED (
  SELECT k, r, a AS s FROM runs UNION ALL SELECT k, r, a || ' ' || b FROM runs WHERE b IS NOT NULL UNION ALL SELECT k, r, a || ' ' || b || ' ' || c FROM runs WHERE c IS NOT NULL),
{crc32("said")},
placed AS (SELECT k, r, CAST(crc % {buckets} AS BIGINT) AS bucket FROM said JOIN checked USING (s)),
counts AS (SELECT bucket, count(*) FILTER (WHERE k = 'd') AS s, count(*) FILTER (WHERE k = 'b') AS t FROM placed GROUP BY bucket),
whole AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM counts),
gains AS (
  SELECT c.bucket, CAST(floor(1000 * ln((c.t + 1)::DOUBLE * (w.s + {buckets})::DOUBLE / ((c.s + 1)::DOUBLE * (w.t + {buckets})::DOUBLE))) AS BIGINT) AS gain
  FROM counts c, whole w),
weights AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM placed JOIN gains USING (bucket) WHERE k = 'd' GROUP BY r),
scored AS (
  SELECT id AS doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= {least} AS fit,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('{seed}:' || coalesce(CAST(id AS VARCHAR), ''))[1:8] AS UBIGINT)::DOUBLE + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM t LEFT JOIN weights USING (r) WHERE k = 'd'),
placed_rows AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= (SELECT count(*) FROM scored WHERE fit) * {percent} // 100 THEN place END AS rank
FROM placed_rows
"""
