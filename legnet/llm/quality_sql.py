"""The quality rules as DuckDB SQL (the check of op4 and of the pipeline's first stage)."""

from __future__ import annotations

from legnet.llm.quality import (
    CLASSES, CLASS_LIMIT, COMMON, MIN_CHARS, MIN_WORDS, REFINES, SOFTEN, WORD_LIMIT,
)

_SQL_CLASSES = [c.replace("'", "''") for c in CLASSES]


def _histogram(counts: list[str]) -> str:
    return "[" + ", ".join(counts) + "]"


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of shares."""
    def part(x: str, y: str) -> str:
        return f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0e0 END"

    terms = f"({part('z[1]', 'z[2]')} + {part('z[2]', 'z[1]')}) / 2"
    return f"sqrt(greatest(0e0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {terms}))))"


def _centres() -> str:
    """CTEs q0 to q<REFINES>: the reference of each language after each round."""
    out = []
    for turn in range(REFINES + 1):
        sums = []
        for name, n in (("class", 6), ("common", 17)):
            d = _distance(f"p_{name}", f"q_{name}") if turn else "0e0"
            weight = f"CASE WHEN p_{name} IS NOT NULL THEN pow({d} + {SOFTEN}, -2) END"
            sums.append((name, n, weight))
        inner = ", ".join(f"{w} AS w_{name}" for name, _, w in sums)
        lists = ", ".join(
            "CASE WHEN sum(w_{0}) > 0 THEN [{1}] END AS q_{0}".format(
                name, ", ".join(f"sum(w_{name} * p_{name}[{i}]) / sum(w_{name})" for i in range(1, n + 1))
            )
            for name, n, _ in sums
        )
        source = f"p JOIN q{turn - 1} USING (lang)" if turn else "p"
        out.append(
            f"q{turn} AS MATERIALIZED (SELECT lang, {lists} FROM (SELECT lang, p_class, p_common, {inner} FROM {source}) GROUP BY lang)"
        )
    return ",\n".join(out)


def verdicts(source: str = "documents") -> str:
    """CTEs up to `verdict`: doc_id, base counts, distances, base_failed, kept."""
    langs = ", ".join(f"'{x}'" for x in COMMON)
    without = ", ".join(
        f"length(body) - length(regexp_replace(body, '[{c}]+', '', 'g'))" for c in _SQL_CLASSES
    )
    common = "CASE lang " + " ".join(
        f"WHEN '{code}' THEN "
        + _histogram([f"len(list_filter(letters, lambda w: w = '{w}'))" for w in words])
        for code, words in COMMON.items()
    ) + " END"
    return f"""
t AS MATERIALIZED (
  SELECT doc_id, CASE WHEN lang IN ({langs}) THEN lang ELSE '' END AS lang, coalesce(text, '') AS body
  FROM {source}),
w AS MATERIALIZED (
  SELECT *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    list_filter(string_split(lower(regexp_replace(body, '[^\\p{{L}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS letters,
    [{without}] AS classes5
  FROM t),
grams AS (
  SELECT doc_id, i, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS k FROM grams SEMI JOIN twice USING (doc_id, g)) GROUP BY doc_id),
f AS MATERIALIZED (
  SELECT w.doc_id, lang, len(words) AS n_words,
    length(regexp_replace(body, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    length(body) - length(regexp_replace(body, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words,
    list_append(classes5, length(body) - list_sum(classes5)) AS classes,
    {common} AS common, len(letters) AS n_letters
  FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id),
p AS MATERIALIZED (
  SELECT *,
    CASE WHEN word_chars >= {MIN_CHARS} THEN list_transform(classes, lambda x: x / list_sum(classes)::DOUBLE) END AS p_class,
    CASE WHEN n_words >= {MIN_WORDS} AND common IS NOT NULL AND n_letters > 0 THEN
      list_transform(list_append(common, n_letters - list_sum(common)), lambda x: x / n_letters::DOUBLE) END AS p_common
  FROM f),
{_centres()},
d AS MATERIALIZED (
  SELECT p.*, CASE WHEN p_class IS NOT NULL THEN {_distance("p_class", "q_class")} END AS class_distance,
    CASE WHEN p_common IS NOT NULL THEN {_distance("p_common", "q_common")} END AS word_distance,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM p JOIN q{REFINES} USING (lang)),
verdict AS MATERIALIZED (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance,
    base_failed, NOT base_failed
      AND coalesce(class_distance, 0) <= {CLASS_LIMIT[0]} + {CLASS_LIMIT[1]} / sqrt(greatest(word_chars, 1))
      AND coalesce(word_distance, 0) <= {WORD_LIMIT[0]} + {WORD_LIMIT[1]} / sqrt(greatest(n_words, 1)) AS kept
  FROM d)"""


SQL = f"""WITH {verdicts()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance, base_failed, kept
FROM verdict"""
