"""DuckDB SQL that the queries over conversations must equal."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    bit = "xor(c >> 1, 3988292384 * (c & 1))"
    byte = f"list_reduce(range(8), lambda c, k: {bit}, xor(r, CAST(unicode(substr({text}, i, 1)) AS BIGINT)))"
    walk = f"list_reduce(range(1, length({text}) + 1), lambda r, i: {byte}, CAST(4294967295 AS BIGINT))"
    return f"xor({walk}, 4294967295)"


#: op11: paths as lists of turns; every node is held against the nodes below it.
TRIE = f"""WITH
t AS (
  SELECT conv_id, turn, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS m,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(m ORDER BY turn NULLS FIRST, digest) AS ms, CAST(conv_id AS VARCHAR) AS name
  FROM t GROUP BY conv_id),
plan AS MATERIALIZED (
  SELECT conv_id, ms, conv_id - ((conv_id % 5) + 5) % 5 AS base, {crc32("name")} % 9 AS h FROM own),
path AS MATERIALIZED (
  SELECT p.conv_id, list_concat(coalesce(b.ms, [])[1:p.h], p.ms[p.h + 1:]) AS path
  FROM plan p LEFT JOIN own b ON b.conv_id = p.base),
step AS MATERIALIZED (
  SELECT conv_id, d, path[1:d] AS node, d = len(path) AS ends
  FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM path)),
node AS MATERIALIZED (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ended
  FROM step GROUP BY node, d),
kids AS MATERIALIZED (SELECT node[1:d - 1] AS node, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
each AS (
  SELECT n.node, n.d, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf,
    CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.node[n.d].t) END AS saved
  FROM node n LEFT JOIN kids k ON k.node = n.node),
up AS (SELECT node, leaf, saved, unnest(range(0, d + 1)) AS a FROM each),
total AS (SELECT node[1:a] AS node, sum(leaf) AS leaves, sum(saved) AS saved FROM up GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
  CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(t.leaves AS BIGINT) AS n_leaves,
  CAST(t.saved AS BIGINT) AS saved_tokens, sha256(n.ended) AS ends_sha256
FROM node n JOIN total t ON t.node = n.node LEFT JOIN kids k ON k.node = n.node
LEFT JOIN node p ON n.d > 0 AND p.node = n.node[1:n.d - 1]"""


def _add(state: str, cost: str, edit: str, line: str | None = None) -> str:
    lines = f"list_append({state}.r, {line})" if line else f"{state}.r"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'r': {lines}}}"


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


_FAR = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}"
_NONE = "{'c': CAST(0 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}"


def _when(condition: str, option: str) -> str:
    return f"CASE WHEN {condition} THEN {option} ELSE {_FAR} END"


def _steps(state: str, role: str, own: str) -> list[str]:
    """Keep and Rerole of a row from one state to the next role."""
    line = "s.role || ':' || s.text"
    keep = _when(f"NOT s.gone AND s.ini = '{own}'", _add(state, "s.cut", "K", line))
    if own == "s":
        return [keep]
    return [keep, _when("NOT s.gone", _add(state, "2 + s.cut", "R", f"'{role}:' || s.text"))]


_ROW = {
    "z": [_add("w.z", "3", "D")],
    "y": [_add("w.y", "3", "D"), *_steps("w.z", "system", "s")],
    "u": [_add("w.u", "3", "D"), *(o for x in "zya" for o in _steps(f"w.{x}", "user", "u"))],
    "a": [_add("w.a", "3", "D"), *_steps("w.u", "assistant", "a")],
}
_USER = _least("u", *(_add(x, "2", "I", "'user:'") for x in ("z", "y", "a")))
_ASSISTANT = _least("a", _add("v", "2", "I", "'assistant:'"))

#: op12: the cheapest way into each of four states (none, system, user, assistant), row by row.
REPAIR = f"""WITH RECURSIVE
k AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
f AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("name")} % 20 AS f
  FROM k),
dam AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
  FROM f WHERE f <> 0),
seq AS MATERIALIZED (
  SELECT conv_id, turn, role, text, substr(role, 1, 1) AS ini,
    regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM dam),
told AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM seq),
rows_ AS MATERIALIZED (
  SELECT *, last = '' AS blank, last = '' OR again AS gone,
    CASE WHEN last IN ('.', '!', '?') THEN 0 ELSE 1 END AS cut,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair
  FROM told),
ids AS MATERIALIZED (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {_NONE} AS z, {_FAR} AS y,
    {_add(_NONE, "2", "I", "'user:'")} AS u, {{'c': CAST(4 AS BIGINT), 'a': 'II', 'r': ['user:', 'assistant:']}} AS a
  FROM ids
  UNION ALL
  SELECT conv_id, i, z, y, v AS u, {_ASSISTANT} AS a
  FROM (SELECT conv_id, i, z, y, a, {_USER} AS v
    FROM (SELECT w.conv_id, s.i, {", ".join(f"{_least(*o)} AS {name}" for name, o in _ROW.items())}
      FROM walk w JOIN rows_ s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1))),
best AS (
  SELECT conv_id, {_least("z", "a")} AS best FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM walk) WHERE back = 1),
stat AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut = 1 AND NOT gone) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, best.c AS cost, best.a AS audit,
  sha256(array_to_string(best.r, chr(10))) AS repaired_sha256
FROM best b LEFT JOIN stat s ON s.conv_id IS NOT DISTINCT FROM b.conv_id"""
