"""DuckDB SQL for every query of the engine, written apart from the Spark expressions."""

from __future__ import annotations

from ..functions.text import TERMINATORS, WHITE_SPACE
from .queries import K, ONE_IN, OVERLAP, PAGE_OVERLAP, PAGE_SIZE, QUESTION, SIZE, WORDS

_STEP, _PAGE_STEP = SIZE - OVERLAP, PAGE_SIZE - PAGE_OVERLAP
_ASKED = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(QUESTION.split())) + "]"
_TOKEN = f"([^{TERMINATORS}]+[{TERMINATORS}]?|[{TERMINATORS}])"


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '{WHITE_SPACE}+'), lambda x: x <> '')"


_CHUNKS = f"""
cut AS (SELECT doc_id, w, unnest(range(0, len(w), {_STEP})) AS i FROM (SELECT doc_id, {_words("text")} AS w FROM documents)),
chunks AS (SELECT doc_id, i // {_STEP} AS pos, array_to_string(w[i + 1:i + {SIZE}], ' ') AS chunk_text FROM cut)"""

#: Needs chunks; a row for each of them.
_ANSWERS = f"""
cw AS (SELECT doc_id, pos, unnest(string_split(chunk_text, ' ')) AS x, generate_subscripts(string_split(chunk_text, ' '), 1) AS n FROM chunks),
placed AS (SELECT *, sum(length(x) + 1) OVER (PARTITION BY doc_id, pos ORDER BY n ROWS UNBOUNDED PRECEDING) - length(x) - 1 AS s FROM cw),
matches AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY length(x) DESC, n) AS k FROM placed WHERE list_contains({_ASKED}, lower(x))),
found AS (SELECT doc_id, pos, count(DISTINCT lower(x)) / len({_ASKED}) AS score FROM matches GROUP BY ALL),
answers AS (
  SELECT c.doc_id, c.pos, c.chunk_text, coalesce(m.x, '') AS answer, coalesce(f.score, 0) AS score,
    CAST(coalesce(m.s, -1) AS BIGINT) AS start_at, CAST(coalesce(m.s + length(m.x), -1) AS BIGINT) AS end_at
  FROM chunks c LEFT JOIN matches m ON m.doc_id = c.doc_id AND m.pos = c.pos AND m.k = 1 LEFT JOIN found f ON f.doc_id = c.doc_id AND f.pos = c.pos)"""

#: Needs answers; the sentences of each chunk, their list, and the number of the anchor.
_ANCHORS = f"""
tokens AS (SELECT doc_id, pos, unnest(regexp_extract_all(chunk_text, '{_TOKEN}')) AS t, generate_subscripts(regexp_extract_all(chunk_text, '{_TOKEN}'), 1) AS n FROM chunks),
ends AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id, pos ORDER BY n ROWS UNBOUNDED PRECEDING) AS e FROM tokens),
spans AS (
  SELECT doc_id, pos, e - length(t) AS s, e, trim(t) AS x, row_number() OVER (PARTITION BY doc_id, pos ORDER BY n) - 1 AS i
  FROM ends WHERE trim(t) <> '' AND NOT (length(t) = 1 AND contains('{TERMINATORS}', t))),
anchors AS (
  SELECT q.doc_id, q.pos, coalesce(min(p.i) FILTER (WHERE p.s <= q.start_at AND q.end_at <= p.e), min(p.i) FILTER (WHERE p.s <= q.start_at AND q.start_at < p.e), 0) AS a
  FROM answers q JOIN spans p ON p.doc_id = q.doc_id AND p.pos = q.pos GROUP BY q.doc_id, q.pos),
sentences AS (
  SELECT q.doc_id, q.pos, coalesce(p.x, q.chunk_text) AS sentence, CAST(coalesce(p.s, 0) AS BIGINT) AS s, CAST(coalesce(p.e, length(q.chunk_text)) AS BIGINT) AS e
  FROM answers q LEFT JOIN anchors n ON n.doc_id = q.doc_id AND n.pos = q.pos LEFT JOIN spans p ON p.doc_id = q.doc_id AND p.pos = q.pos AND p.i = n.a)"""

#: Needs anchors; grows the range of sentences, left before right, as far as the limit of 140 words and its shares let it.
_PARAGRAPHS = f"""
lists AS (SELECT doc_id, pos, list(x ORDER BY i) AS xs, list(len({_words("x")}) ORDER BY i) AS ws FROM spans GROUP BY doc_id, pos),
grow(doc_id, pos, ws, lo, hi, total, moved) AS (
  SELECT l.doc_id, l.pos, l.ws, n.a, n.a, l.ws[n.a + 1], TRUE FROM lists l JOIN anchors n ON n.doc_id = l.doc_id AND n.pos = l.pos
  UNION ALL
  SELECT doc_id, pos, ws, lo, CASE WHEN take THEN hi + 1 ELSE hi END, CASE WHEN take THEN total + ws[hi + 2] ELSE total END, took OR take FROM (
    SELECT *, hi < len(ws) - 1 AND (total + ws[hi + 2] <= 140 OR total < 0.8 * 140) AS take FROM (
      SELECT doc_id, pos, ws, CASE WHEN take THEN lo - 1 ELSE lo END AS lo, hi, CASE WHEN take THEN total + ws[lo] ELSE total END AS total, take AS took FROM (
        SELECT *, lo > 0 AND (total + ws[lo] <= 140 OR total < 0.6 * 140) AS take FROM grow WHERE moved AND total < 140)))
),
ranges AS (SELECT doc_id, pos, min(lo) AS lo, max(hi) AS hi FROM grow GROUP BY doc_id, pos),
paragraphs AS (
  SELECT c.doc_id, c.pos, coalesce(array_to_string(l.xs[r.lo + 1:r.hi + 1], ' '), c.chunk_text) AS paragraph
  FROM chunks c LEFT JOIN lists l ON l.doc_id = c.doc_id AND l.pos = c.pos LEFT JOIN ranges r ON r.doc_id = c.doc_id AND r.pos = c.pos)"""

_PATH = """CASE doc_id % 4 WHEN 0 THEN './d/' || source || ' - ' || lang || ' - ' || (1950 + doc_id % 100) || '.pdf'
  WHEN 1 THEN '/d/' || lang || '_' || source || '_' || (1990 + doc_id % 40) || '.PDF'
  WHEN 2 THEN source || '.' || lang || '.pdf' ELSE '/d/Self-' || source || '_' || (2010 + doc_id % 80) || '.pdf' END"""

_META = f"""
paths AS (SELECT doc_id, {_PATH} AS path FROM documents),
bases AS (SELECT doc_id, path, regexp_extract(path, '([^/]*)$', 1) AS base FROM paths),
stems AS (SELECT *, CASE WHEN regexp_extract(base, '^(\\.*[^.].*)\\.[^.]*$', 1) <> '' THEN regexp_extract(base, '^(\\.*[^.].*)\\.[^.]*$', 1) ELSE base END AS stem FROM bases),
parts AS (
  SELECT *, list_filter(list_transform(string_split(stem, '-'), lambda x: trim(x)), lambda x: x <> '') AS h,
    list_filter(list_transform(string_split(stem, '_'), lambda x: trim(x)), lambda x: x <> '') AS u FROM stems),
meta AS (
  SELECT doc_id, path,
    coalesce(nullif(CASE WHEN len(h) >= 2 THEN h[1] WHEN len(u) >= 2 THEN array_to_string(u[2:], ' ') ELSE stem END, ''), base) AS title,
    CASE WHEN len(h) >= 2 THEN h[2] END AS author,
    CAST(nullif(regexp_extract(stem, '((19|20)[0-9][0-9])', 1), '') AS BIGINT) AS publication_year,
    CASE WHEN len(h) < 2 AND len(u) >= 2 THEN u[1] END AS department
  FROM parts)"""


def _dot(x: str, y: str) -> str:
    return f"list_dot_product(CAST({x} AS DOUBLE[]), CAST({y} AS DOUBLE[]))"


#: Needs chunks; the K chunks whose document's vector is nearest to that of document 0.
_HITS = f"""
scored AS (
  SELECT c.doc_id, c.pos, c.chunk_text, (1 + {_dot("e.embedding", "q.embedding")}) / 2 AS retrieval_score
  FROM chunks c JOIN embeddings e ON e.vec_id = c.doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY retrieval_score DESC, doc_id, pos) AS rank FROM scored) WHERE rank <= {K})"""


#: Needs chunks; BM25 scores and ranks of all chunks that have a word of the search.
_BM25 = f"""
tokens_of AS (SELECT doc_id, pos, regexp_extract_all(lower(chunk_text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS w FROM chunks),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS average FROM tokens_of),
asked AS (SELECT DISTINCT unnest(string_split(lower('{WORDS}'), ' ')) AS term),
counted AS (SELECT doc_id, pos, len(w) AS length, term, len(list_filter(w, lambda x: x = term)) AS tf FROM tokens_of, asked),
weights AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS weight FROM counted, corpus WHERE tf > 0 GROUP BY term),
scores AS (
  SELECT doc_id, pos, round(sum(weight * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / average)))), 9) AS score
  FROM counted JOIN weights USING (term), corpus WHERE tf > 0 GROUP BY doc_id, pos),
said AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, pos) AS rank FROM scores)"""


def _gap(c: str, n: int) -> str:
    return f"CASE doc_id % {n} WHEN 0 THEN NULL WHEN 1 THEN '' ELSE {c} END"


def oracle_sql() -> dict[str, str]:
    return {
        "vector_topk": f"""
            WITH best AS (SELECT vec_id, (1 + {_dot("e.embedding", "q.embedding")}) / 2 AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
            ranked AS (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM best)
            SELECT CAST(r.rank AS INTEGER) AS rank, r.vec_id, round(r.s, 6) AS score, d.text FROM ranked r JOIN documents d ON d.doc_id = r.vec_id WHERE r.rank <= {K}""",
        "vector_topk_batch": f"""
            WITH scored AS (SELECT q.vec_id AS query_id, e.vec_id, (1 + {_dot("e.embedding", "q.embedding")}) / 2 AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM scored)
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(s, 6) AS score FROM ranked WHERE rank <= {K}""",
        "ann_recall": f"""
            SELECT count(*) AS n_queries, count(*) * least({K}, (SELECT count(*) FROM embeddings)) AS n_exact, count(*) * least({K}, (SELECT count(*) FROM embeddings)) AS n_returned,
              count(*) * least({K}, (SELECT count(*) FROM embeddings)) AS n_right, true AS reached FROM embeddings WHERE vec_id % 50 = 0""",
        "filtered_recall": " UNION ALL ".join(
            f"""
            SELECT count(*) AS n_queries, count(*) * least({K}, any_value(n)) AS n_exact, count(*) * least({K}, any_value(n)) AS n_returned, count(*) * least({K}, any_value(n)) AS n_right,
              true AS reached, {n} AS one_in FROM embeddings, (SELECT count(*) AS n FROM embeddings WHERE vec_id % {n} = 1) WHERE vec_id % 50 = 0"""
            for n in ONE_IN
        ),
        "bm25_topk": f"WITH {_CHUNKS}, {_BM25} SELECT doc_id, pos, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM said WHERE rank <= {K}",
        "hybrid_topk": f"""
            WITH {_CHUNKS}, {_BM25},
            near AS (
              SELECT doc_id, pos, row_number() OVER (ORDER BY s DESC, doc_id, pos) AS rank
              FROM (SELECT c.doc_id, c.pos, (1 + {_dot("e.embedding", "q.embedding")}) / 2 AS s FROM chunks c JOIN embeddings e ON e.vec_id = c.doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)),
            fused AS (
              SELECT doc_id, pos, n.rank AS vector_rank, s.rank AS word_rank, coalesce(1 / (60 + n.rank), 0) + coalesce(1 / (60 + s.rank), 0) AS score
              FROM near n FULL JOIN said s USING (doc_id, pos)),
            placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, pos) AS rank FROM fused)
            SELECT doc_id, pos, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, vector_rank, word_rank FROM placed WHERE rank <= {K}""",
        "highlights": f"""
            WITH {_CHUNKS},
            pieces AS (SELECT doc_id, pos, unnest(regexp_extract_all(chunk_text, '[\\p{{L}}\\p{{M}}\\p{{N}}]+|[^\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS x, generate_subscripts(regexp_extract_all(chunk_text, '[\\p{{L}}\\p{{M}}\\p{{N}}]+|[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), 1) AS i FROM chunks),
            placed AS (SELECT *, CAST(sum(length(x)) OVER (PARTITION BY doc_id, pos ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM pieces),
            found AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY i) AS k FROM placed WHERE list_contains(string_split(lower('{WORDS}'), ' '), lower(x)))
            SELECT doc_id, pos, count(*) AS n, string_agg((e - length(x)) || '-' || e, ' ' ORDER BY k) FILTER (WHERE k <= 5) AS places FROM found GROUP BY doc_id, pos""",
        "facets": f"""
            WITH {_CHUNKS}, {_BM25},
            found AS (SELECT d.lang, d.source FROM said JOIN documents d USING (doc_id))
            SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM found GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM found GROUP BY source
            UNION ALL SELECT 'lang|source', lang || '|' || source, count(*) FROM found GROUP BY lang, source""",
        "vector_pages": f"""
            WITH best AS (SELECT vec_id, (1 + {_dot("e.embedding", "q.embedding")}) / 2 AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
            ranked AS (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) - 1 AS r FROM best)
            SELECT CAST(r // {K} AS INTEGER) AS page, CAST(r % {K} + 1 AS INTEGER) AS rank, vec_id, round(s, 6) AS score FROM ranked WHERE r >= {K} AND r < 3 * {K}""",
        "language_codes": """
            WITH plain AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{M}]+', ' ', 'g')) || ' ' AS x FROM documents),
            letters AS (SELECT doc_id, lang, unnest(list_transform(string_split(x, ''), lambda c: unicode(c))) AS a, generate_subscripts(string_split(x, ''), 1) AS i FROM plain),
            runs AS (SELECT doc_id, lang, a * 961 + lead(a) OVER w * 31 + lead(a, 2) OVER w AS b FROM letters WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
            placed AS (SELECT doc_id, lang, b % 4096 AS b FROM runs WHERE b IS NOT NULL),
            counts AS (SELECT lang, b, count(*) AS n FROM placed WHERE doc_id % 4 <> 2 AND lang IS NOT NULL GROUP BY lang, b),
            sizes AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang),
            weights AS (
              SELECT s.lang AS code, k.b, floor(1000 * ln((coalesce(c.n, 0) + 1)::DOUBLE / (s.total + 4096)::DOUBLE)) AS w
              FROM sizes s CROSS JOIN (SELECT unnest(range(4096)) AS b) k LEFT JOIN counts c ON c.lang = s.lang AND c.b = k.b),
            own AS (SELECT doc_id, b, count(*) AS n FROM placed GROUP BY doc_id, b),
            scores AS (SELECT doc_id, code, sum(n * w) AS score FROM own JOIN weights USING (b) GROUP BY doc_id, code),
            best AS (SELECT doc_id, code FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) AS k FROM scores) WHERE k = 1)
            SELECT d.doc_id, b.code AS language_code, d.doc_id % 4 = 2 AS held_out FROM documents d LEFT JOIN best b USING (doc_id)""",
        "books_registry": """
            SELECT row_number() OVER (ORDER BY path) AS id, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS title, source AS author, CAST(1990 AS BIGINT) AS publication_year, path AS file_path
            FROM (SELECT doc_id, source, './d/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || ' - ' || source || ' - 1990.pdf' AS path FROM documents)
            WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""",
        "index_rows": f"""
            WITH p AS (SELECT conv_id, turn, {_words("replace(text, chr(0), '')")} AS w FROM conversations),
            cut AS (SELECT conv_id, turn, w, unnest(range(0, len(w), {_PAGE_STEP})) AS i FROM p),
            rows_ AS (
              SELECT *, dense_rank() OVER (ORDER BY conv_id) AS book_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS n, row_number() OVER (ORDER BY conv_id, turn, i) AS chunk_id FROM cut)
            SELECT 'book-' || book_id || '-chunk-' || n AS es_doc_id, book_id, chunk_id, n AS chunk_index, CAST(turn AS BIGINT) AS page_number, 'Talk' AS title,
              lpad(CAST(conv_id AS VARCHAR), 12, '0') AS author, array_to_string(w[i + 1:i + {PAGE_SIZE}], ' ') AS text FROM rows_""",
        "normalize_vectors": f"""
            WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt({_dot("embedding", "embedding")}) AS n FROM embeddings),
            u AS (SELECT vec_id, n, list_transform(v, lambda x: x / n) AS u FROM n)
            SELECT vec_id, round(n, 6) AS norm, round(sqrt(list_dot_product(u, u)), 6) AS unit_norm, round(list_aggregate(u, 'sum'), 6) AS unit_sum FROM u""",
        "text_normalize": f"SELECT doc_id, array_to_string({_words('text')}, ' ') AS text, CAST(len({_words('text')}) AS BIGINT) AS n_words FROM documents",
        "sanitize_text": "SELECT doc_id, replace(text, chr(0), '') AS text, length(replace(text, chr(0), '')) AS n_chars FROM documents",
        "word_chunks": f"WITH {_CHUNKS} SELECT doc_id, pos, chunk_text FROM chunks",
        "page_chunks": f"""
            WITH p AS (SELECT conv_id, turn, {_words("replace(text, chr(0), '')")} AS w FROM conversations),
            cut AS (SELECT conv_id, turn, w, unnest(range(0, len(w), {_PAGE_STEP})) AS i FROM p)
            SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS chunk_index, i // {_PAGE_STEP} AS pos, array_to_string(w[i + 1:i + {PAGE_SIZE}], ' ') AS chunk_text FROM cut""",
        "filename_metadata": f"WITH {_META} SELECT doc_id, path, title, author, publication_year, department FROM meta",
        "doc_ids": f"WITH {_CHUNKS} SELECT doc_id, pos, 'book-' || doc_id || '-chunk-' || pos AS es_doc_id FROM chunks",
        "sentence_spans": f"""
            WITH t AS (SELECT doc_id, array_to_string({_words('text')}, ' ') AS x FROM documents),
            k AS (SELECT doc_id, unnest(regexp_extract_all(x, '{_TOKEN}')) AS t, generate_subscripts(regexp_extract_all(x, '{_TOKEN}'), 1) AS n FROM t),
            e AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS e FROM k)
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS n, CAST(e - length(t) AS BIGINT) AS start_at, CAST(e AS BIGINT) AS end_at, trim(t) AS sentence
            FROM e WHERE trim(t) <> '' AND NOT (length(t) = 1 AND contains('{TERMINATORS}', t))""",
        "sentence_split": f"""
            WITH k AS (SELECT doc_id, list_filter(list_transform(list_filter(regexp_extract_all(text, '{_TOKEN}'), lambda t: NOT (length(t) = 1 AND contains('{TERMINATORS}', t))), lambda t: regexp_replace(t, '^{WHITE_SPACE}+|{WHITE_SPACE}+$', '', 'g')), lambda t: t <> '') AS x FROM documents)
            SELECT doc_id, CAST(len(x) AS BIGINT) AS n_sentences, array_to_string(x, '|') AS joined FROM k""",
        "lexical_answer": f"WITH {_CHUNKS}, {_ANSWERS} SELECT doc_id, pos, answer, round(score, 6) AS score, start_at, end_at FROM answers",
        "complete_sentence": f"""
            WITH {_CHUNKS}, {_ANSWERS}, {_ANCHORS}
            SELECT s.doc_id, s.pos, s.sentence, s.s AS start_at, s.e AS end_at, coalesce(nullif(s.sentence, ''), q.answer) AS quote
            FROM sentences s JOIN answers q ON q.doc_id = s.doc_id AND q.pos = s.pos""",
        "matched_paragraph": f"WITH RECURSIVE {_CHUNKS}, {_ANSWERS}, {_ANCHORS}, {_PARAGRAPHS} SELECT doc_id, pos, paragraph FROM paragraphs",
        "rerank": f"""
            WITH {_CHUNKS}, {_ANSWERS}, {_HITS}
            SELECT h.doc_id, h.pos, CAST(h.rank AS INTEGER) AS rank, round(h.retrieval_score, 6) AS retrieval_score, round(q.score, 6) AS qa_score,
              CAST(row_number() OVER (ORDER BY round(q.score, 6) DESC, h.rank) AS INTEGER) AS place
            FROM hits h JOIN answers q ON q.doc_id = h.doc_id AND q.pos = h.pos WHERE h.chunk_text <> ''""",
        "search_and_extract": f"""
            WITH RECURSIVE {_CHUNKS}, {_ANSWERS}, {_ANCHORS}, {_PARAGRAPHS}, {_META}, {_HITS}
            SELECT CAST(h.rank AS INTEGER) AS rank, round(h.retrieval_score, 6) AS retrieval_score, round(q.score, 6) AS qa_score,
              coalesce(nullif(s.sentence, ''), q.answer) AS quote, s.s AS start_at, s.e AS end_at, m.title AS book_title, m.author, m.department,
              h.pos + 1 AS page_number, m.path AS file_path, p.paragraph AS matched_paragraph, h.chunk_text AS chunk_preview
            FROM hits h JOIN answers q ON q.doc_id = h.doc_id AND q.pos = h.pos JOIN sentences s ON s.doc_id = h.doc_id AND s.pos = h.pos
            JOIN paragraphs p ON p.doc_id = h.doc_id AND p.pos = h.pos JOIN meta m ON m.doc_id = h.doc_id WHERE h.chunk_text <> ''""",
        "response_projection": f"""
            WITH r AS (
              SELECT doc_id, source AS quote, {_gap("source", 5)} AS title, {_gap("lang", 6)} AS author, lang AS department,
                CASE WHEN doc_id % 3 > 0 THEN doc_id % 90 END AS page, {_gap(_PATH, 7)} AS path, {_gap("text", 4)} AS paragraph, {_gap("lang", 9)} AS chunk FROM documents),
            f AS (
              SELECT doc_id, coalesce(quote, '') AS exact_quote, coalesce(nullif(title, ''), 'Unknown Title') AS book_title, coalesce(nullif(author, ''), 'Unknown Author') AS author, department,
                coalesce(page, 0) AS page_number,
                CASE WHEN coalesce(path, '') = '' THEN '#' WHEN starts_with(path, './') THEN '/' || substr(path, 3) WHEN starts_with(path, '/') THEN path ELSE '/' || path END AS pdf_link,
                coalesce(nullif(paragraph, ''), chunk, '') AS paragraph_text FROM r)
            SELECT *, pdf_link || '#page=' || page_number AS preview, coalesce(nullif(paragraph_text, ''), 'Paragraph text unavailable for this hit.') AS paragraph_shown FROM f""",
        "new_documents": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
        "path_filter": "SELECT page_id, url FROM pages WHERE ends_with(lower(url), '.html')",
    }
