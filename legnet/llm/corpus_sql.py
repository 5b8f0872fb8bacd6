"""DuckDB SQL of the joins and searches over the whole corpus."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: op3: sets of three-word shingles, links at nine tenths, components by closure.
JACCARD = f"""WITH RECURSIVE
w AS MATERIALIZED (
  SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS words
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3
    THEN [list_aggregate(words, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS grams
  FROM w),
g AS MATERIALIZED (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (
  SELECT DISTINCT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, coalesce(c.least, doc_id) AS component_id
FROM s LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) c ON c.a = doc_id"""

#: op7: what an archive and its index must give back.
ARCHIVE = """WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p),
r AS (SELECT *, strlen(html) >= 100 AND page_id <> first AS again FROM f)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM r"""

#: op10: windows of twenty words, all but the first removed.
PHRASES = f"""WITH
w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
win AS MATERIALIZED (
  SELECT doc_id, i, list_aggregate(words[i:i + 19], 'string_agg', ' ') AS phrase
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) AS turn FROM win) WHERE turn > 1),
gone AS MATERIALIZED (
  SELECT doc_id, list(DISTINCT k) AS ks FROM (
    SELECT doc_id, unnest(range(i, i + 20)) AS k FROM later) GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS k, unnest(words) AS word FROM w),
rest AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.k) AS text FROM pos p
  WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT doc_id, unnest(ks) AS k FROM gone) x WHERE x.doc_id = p.doc_id AND x.k = p.k)
  GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN rest USING (doc_id)"""
