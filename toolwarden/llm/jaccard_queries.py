"""N-gram Jaccard join: the registered query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .jaccard import jaccard_components
from .registry import query, table


JACCARD_SQL = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (SELECT DISTINCT r, array_to_string(words[i:i+4], ' ') AS s FROM (
    SELECT r, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM docs WHERE len(words) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT r AS a, r AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(d.doc_id) AS component_id FROM reach JOIN docs d ON d.r = b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, copies FROM docs d JOIN least ON a = d.r LEFT JOIN sizes z ON z.r = d.r
JOIN (SELECT r, count(*) OVER (PARTITION BY coalesce(l, CAST(r AS VARCHAR))) AS copies FROM (
    SELECT d.r, string_agg(s, chr(10) ORDER BY s) AS l FROM docs d LEFT JOIN shingles s ON s.r = d.r GROUP BY d.r)) k ON k.r = d.r"""


@query("op8_jaccard_join", JACCARD_SQL)
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shingle count and the component of its Jaccard links."""
    return jaccard_components(table(spark, sf_dir, "documents"))
