"""Adaptive quality rules: the registered query and its check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import rules
from .registry import query, table


def _sql() -> str:
    value = {f.name: f"CAST(floor({f.part} * {f.scale} / greatest({f.whole}, 1)) AS BIGINT)" for f in rules.FEATURES}
    long = " UNION ALL ".join(f"SELECT lang, source, '{f.name}' AS feature, {value[f.name]} AS v FROM counted WHERE NOT base_failed"
                              for f in rules.FEATURES)
    spread = "CASE feature " + " ".join(f"WHEN '{f.name}' THEN {f.spread}" for f in rules.FEATURES) + " END"
    arms = " ".join(
        f"WHEN {value[f.name]} > high['{f.name}']" + (f" OR {value[f.name]} < low['{f.name}']" if f.low else "")
        + f" THEN '{f.name}'" for f in rules.FEATURES)
    word = r"'[^\x20\x09-\x0D]+'"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, {word}) AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, {word})) AS lines FROM docs),
places AS (SELECT r, unnest(range(1, len(words) - 6)) AS i, words FROM split WHERE len(words) >= 8),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(words[i:i+7], ' ')) AS n FROM places),
covered AS (SELECT r, count(DISTINCT w) AS n_repeat_words FROM (
    SELECT r, unnest(range(i, i + 8)) AS w FROM windows WHERE n > 1) GROUP BY r),
plain AS (SELECT s.r, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM split s LEFT JOIN covered c ON c.r = s.r),
counted AS (SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words AS base_failed FROM plain),
long AS ({long}),
shifted AS (SELECT *, CAST(greatest(length(bin(v)) - {rules.LEADING_BITS}, 0) AS INT) AS s FROM long),
levels AS (SELECT level, CASE WHEN level < 2 THEN lang END AS lang, CASE WHEN level < 1 THEN source END AS source, feature,
    (v >> s) << s AS b FROM shifted, (VALUES (0), (1), (2)) t(level)),
ranked AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY level, lang, source, feature ORDER BY b) AS k
    FROM levels WINDOW w AS (PARTITION BY level, lang, source, feature)),
quartiles AS (SELECT level, lang, source, feature, max(n) AS n, min(b) FILTER (4 * k >= n) AS q1,
    min(b) FILTER (4 * k >= 3 * n) AS q3 FROM ranked GROUP BY ALL),
sides AS (SELECT level, lang, source, max(n) AS n,
    map_from_entries(list((feature, CAST(q1 - {rules.REACH} * greatest(q3 - q1, {spread}) AS BIGINT)))) AS low,
    map_from_entries(list((feature, CAST(q3 + {rules.REACH} * greatest(q3 - q1, {spread}) AS BIGINT)))) AS high
    FROM quartiles GROUP BY ALL),
grouped AS (SELECT lang, source, CASE WHEN n >= {rules.GROUP_ROWS} THEN 0
    WHEN sum(n) OVER (PARTITION BY lang) >= {rules.GROUP_ROWS} THEN 1 ELSE 2 END AS level FROM sides WHERE level = 0),
fences AS (SELECT g.lang, g.source, low, high FROM grouped g JOIN sides s ON s.level = g.level
    AND s.lang IS NOT DISTINCT FROM CASE WHEN g.level < 2 THEN g.lang END
    AND s.source IS NOT DISTINCT FROM CASE WHEN g.level < 1 THEN g.source END),
judged AS (SELECT c.*, CASE WHEN base_failed THEN 'base' {arms} END AS reason FROM counted c LEFT JOIN fences f
    ON f.lang IS NOT DISTINCT FROM c.lang AND f.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, {', '.join(rules.COUNTS)}, base_failed, reason IS NULL AS kept, reason FROM judged"""


@query("op13_quality_rules", _sql())
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every whole document under cutoffs of its language and source."""
    return rules.quality_rules(table(spark, sf_dir, "documents"))
