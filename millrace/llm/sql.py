"""DuckDB equivalents of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = f"""
WITH item_words AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
item_grams AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS k, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)
),
sizes AS (SELECT item_id, count(*) AS n FROM item_grams GROUP BY item_id),
doc_words AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
doc_grams AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
    FROM doc_words, (SELECT DISTINCT k FROM item_grams) WHERE len(w) >= k
  )
),
shared AS (SELECT doc_id, item_id, count(*) AS c FROM doc_grams JOIN item_grams USING (k, gram) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, CAST(c AS BIGINT) AS n_shared, c / n AS containment
FROM shared JOIN sizes USING (item_id) WHERE c >= ceil(0.8 * n - 1e-9)
"""

def lines(documents: str, min_words: int = 20) -> str:
    """Common table expressions that end in ``line_runs`` (doc_id, a, z) and ``line_kept`` (doc_id, n_lines, n_removed, kept), for rows whose ids differ.

    By definition, without fingerprints or hashes: all smallest runs of lines that reach ``min_words`` words from their
    start or from their end, as texts; those that stand earlier go. A run that is repeated is the union of such runs.
    """
    return rf"""
line_texts AS (SELECT doc_id, string_split(regexp_replace(replace(coalesce(text, ''), chr(1), ' '), '(?:\n|[.!?] )[ \t\r\n]*', '\0' || chr(1), 'g'), chr(1)) AS lines FROM {documents}),
line_keys AS (
  SELECT doc_id, i - 1 AS i, line, key, CASE WHEN key = '' THEN 0 ELSE len(regexp_split_to_array(key, '[ \t\r\n]+')) END AS w
  FROM (SELECT doc_id, i, line, trim(line, ' ' || chr(9) || chr(13) || chr(10)) AS key FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM line_texts))
),
line_sums AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM line_keys),
line_lists AS (SELECT doc_id, list(key ORDER BY i) AS keys FROM line_keys GROUP BY doc_id),
line_pairs AS (
  SELECT s.doc_id, s.i AS a, t.i AS z FROM line_sums s JOIN line_sums t ON t.doc_id = s.doc_id AND t.i >= s.i AND t.i <= s.i + {min_words}
  WHERE s.w > 0 AND t.w > 0 AND t.upto - s.upto + s.w >= {min_words} AND (t.upto - t.w - s.upto + s.w < {min_words} OR t.upto - s.upto < {min_words})
),
line_windows AS (SELECT doc_id, a, z, array_to_string(keys[a + 1:z + 1], chr(1)) AS words FROM line_pairs JOIN line_lists USING (doc_id)),
line_again AS (SELECT doc_id, a, z FROM (SELECT *, row_number() OVER (PARTITION BY words ORDER BY doc_id, a) AS nth FROM line_windows) WHERE nth > 1),
line_gone AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM line_again),
line_runs AS (SELECT doc_id, min(i) AS a, max(i) AS z FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM line_gone) GROUP BY doc_id, run),
line_kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.line END, '' ORDER BY l.i), '') AS kept
  FROM line_keys l LEFT JOIN line_gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
"""


OP2 = f"""
WITH {lines("documents")}
SELECT k.doc_id, k.n_lines, k.n_removed, (SELECT count(*) FROM line_runs r WHERE r.doc_id = k.doc_id) AS n_runs, md5(k.kept) AS kept_md5
FROM line_kept k
"""


#: Every byte covered by a string of 100 bytes that starts earlier too; bytes as two hexadecimal digits. For distinct, non-null ids.
OP3 = """
WITH bytes AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
sized AS (SELECT doc_id, h, length(h) // 2 AS n FROM bytes),
windows AS (SELECT doc_id, i, substring(h, 2 * i + 1, 200) AS w FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 99, 0))) AS i FROM sized)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1),
marked AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM later),
numbered AS (SELECT doc_id, i, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS z FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT doc_id, span, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY span), 0) AS since FROM spans),
kept AS (
  SELECT s.doc_id, any_value(s.n) AS n, coalesce(sum(g.z - g.a), 0) AS gone, count(g.a) AS spans,
    coalesce(string_agg(substring(s.h, 2 * g.since + 1, 2 * (g.a - g.since)), '' ORDER BY g.span), '') || substring(any_value(s.h), 2 * coalesce(max(g.z), 0) + 1) AS h
  FROM sized s LEFT JOIN gaps g ON g.doc_id = s.doc_id GROUP BY s.doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(h)) AS kept_sha256 FROM kept
"""

#: Links by cosine in double precision, components by the ids that links reach.
OP6 = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""
