"""DuckDB SQL of the quality rules with their default parameters."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_NOT_SPACE = r"[^\x20\x09-\x0D]"
_CLASSES = (
    r"[a-z]",
    r"[A-Z]",
    r"[0-9]",
    r"[\x20\x09-\x0D]",
    r"[.,;:!?''\x22()-]",
    r"[\x00-\x08\x0E-\x1F#$%&*+/<=>@\[\\\]^_`{|}~\x7F]",
    r"[^\x00-\x7F]",
)


def _count(pattern: str) -> str:
    return f"len(text) - len(regexp_replace(text, '{pattern}', '', 'g'))"


def _distance(counts: str, reference: str, size: int) -> str:
    p, q = f"({counts}[i] / list_sum({counts}))", f"({reference}[i] / list_sum({reference}))"
    half = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, {size + 1}), lambda i: 0.5 * ({half(p)} + {half(q)})))))"


#: The histogram of a text without any common word.
_LACKING = "[" + "0, " * 24 + "1]"


def _sums(column: str, size: int) -> str:
    return "[" + ", ".join(f"sum({column}[{k}]) FILTER (NOT base_failed)" for k in range(1, size + 1)) + "]"


SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT r, doc_id, lang, text,
         regexp_extract_all(text, '{_NOT_SPACE}+') AS ws,
         regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_NOT_SPACE}+') AS lower_ws
  FROM docs
), windows AS (
  SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS w
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM split WHERE len(ws) >= 5)
), repeated AS (
  SELECT r, count(DISTINCT k) AS n_repeat_words
  FROM (SELECT r, unnest(range(i, i + 5)) AS k FROM windows JOIN (SELECT r, w FROM windows GROUP BY r, w HAVING count(*) > 1) USING (r, w))
  GROUP BY r
), lines AS (
  SELECT r, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM split)
  WHERE regexp_matches(line, '{_NOT_SPACE}') GROUP BY r
), counted AS (
  SELECT r, doc_id, lang, lower_ws, CAST(len(ws) AS BIGINT) AS n_words,
         CAST({_count(_NOT_SPACE)} AS BIGINT) AS word_chars,
         CAST({_count("[#*$%&|<>]")} AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         [{", ".join(_count(p) for p in _CLASSES)}] AS classes
  FROM split LEFT JOIN repeated USING (r) LEFT JOIN lines USING (r)
), ruled AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
), large AS (
  SELECT lang, count(*) AS n_docs, sum(n_words) AS n_lang_words FROM ruled WHERE NOT base_failed AND lang <> '' GROUP BY lang
  HAVING 256 * count(*) >= (SELECT count(*) FROM ruled WHERE NOT base_failed)
), spread AS (
  SELECT lang, w, count(DISTINCT r) AS n_with, count(*) AS n_times
  FROM (SELECT r, lang, unnest(lower_ws) AS w FROM ruled WHERE NOT base_failed) WHERE len(w) <= 32 GROUP BY lang, w
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_with DESC, w) AS place FROM spread
), bins AS (
  SELECT lang, list(w ORDER BY place) AS list
  FROM ranked JOIN large USING (lang) WHERE place <= 24 AND n_docs >= 50
  GROUP BY lang, n_lang_words HAVING 100 * sum(n_times) >= 10 * n_lang_words
), base AS (
  SELECT ruled.*, coalesce(large.lang, '') AS reference, list IS NOT NULL AS worded,
         CASE WHEN list IS NULL THEN list_transform(range(25), lambda k: 0)
              ELSE list_transform(range(1, 26), lambda k: CASE WHEN k <= 24 THEN len(list_filter(lower_ws, lambda x: x = list[k]))
                                                       ELSE len(list_filter(lower_ws, lambda x: NOT list_contains(list, x))) END) END AS common
  FROM ruled LEFT JOIN large USING (lang) LEFT JOIN bins USING (lang)
), refs AS (
  SELECT reference, {_sums("classes", 7)} AS ref_classes, {_sums("common", 25)} AS ref_common FROM base GROUP BY reference
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND NOT coalesce(word_chars >= 200 AND {_distance("classes", "ref_classes", 7)} > 0.3, false)
       AND NOT coalesce(n_words >= 100 AND worded AND {_distance("common", "ref_common", 25)} > 0.9 * {_distance(_LACKING, "ref_common", 25)}, false) AS kept
FROM base JOIN refs USING (reference)
"""
