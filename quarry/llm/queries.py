"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import contamination
from .html_extract import extract
from .importance import select
from .jaccard_join import near_duplicates
from .license_scan import scan
from .packing import pack
from .pii import find
from .quality_rules import BOILERPLATE, measure
from .substring_dedup import remove_repeats
from .toxicity import learn, score


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


#: What the template of the given pages comes to: an article, two kinds of character references.
_OP8 = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|<footer>|$)', 1), '</?b>', '', 'g') AS inner_html FROM pages),
t AS (SELECT page_id, url, replace(regexp_replace(inner_html, '<[^>]*(>|$)', ' ', 'g'), '&quot;', '"') AS t FROM a),
u AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM t)
SELECT page_id, url, text, CAST(len(text) AS BIGINT) AS n_chars FROM u
"""

_OP10 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY list_slice(w, k, k + 19) ORDER BY doc_id, k) > 1 AS again
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM words WHERE len(w) >= 20)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS k FROM windows WHERE again
), one AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM words
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n
  FROM one ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept USING (doc_id)
"""


_OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
windows AS (
  SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, list_slice(w, k, k + 7)) > 1 AS again
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM w WHERE len(w) >= 8)
), repeated AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(k, k + 8)) AS k FROM windows WHERE again) GROUP BY doc_id
), split_lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
), lines AS (
  SELECT doc_id, line, len(lw) AS n, lw FROM (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM split_lines) WHERE len(lw) > 0
), judged AS (
  SELECT doc_id, n, line,
    len(line) - len(regexp_replace(line, '[#*$%&|<>]', '', 'g')) > n * 0.3
    OR (n >= 5 AND len(line) - len(replace(line, '!', '')) > n * 0.3)
    OR (n >= 5 AND NOT regexp_matches(line, '\p{{Ll}}') AND regexp_matches(line, '\p{{Lu}}'))
    OR (n >= 60 AND NOT regexp_matches(line, '[.!?;:,…。]'))
    OR len(list_filter(range(2, len(lw) + 1), lambda i: lw[i] = lw[i - 1])) * 100 > len(lw) * 50
    OR regexp_matches(lower(line), '{BOILERPLATE}') AS bad
  FROM lines
), by_doc AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup, sum(n) AS total, sum(CASE WHEN bad THEN n ELSE 0 END) AS lost FROM judged GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(w.w) AS n_words, len(array_to_string(w.w, '')) AS word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup, 0) AS dup, coalesce(repeated.n, 0) AS again, coalesce(total, 0) AS total, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN repeated USING (doc_id) LEFT JOIN by_doc USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
  CAST(again AS BIGINT) AS n_repeat_words, n_words < 20 OR 100 * again > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * again > 30 * n_words) AND 100 * lost <= 40 * total AS kept, CASE WHEN total > 0 THEN lost / total ELSE 0 END AS lost_share
FROM m
"""

_OP6 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, list_slice(w, k, k + 4) AS s
  FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [1] ELSE range(1, len(w) - 3) END) AS k FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT p.a, p.b
  FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both
        FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b
  WHERE 100 * p.both >= 80 * (m.n + n.n - p.both)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.doc_id = d.doc_id
GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _OP2, "op6_jaccard_join": _OP6, "op8_html_extraction": _OP8, "op10_substring_dedup": _OP10}
