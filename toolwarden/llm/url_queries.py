"""URL filter: the registered query and its check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import urls
from .registry import query, table

#: The rules of the query: verdict and host suffix with path prefix.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/")]


def _rules_sql() -> str:
    cases = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        name, _, prefix = rule.partition("/")
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{prefix}') "
                     f"THEN {{'rule': '{rule}', 'verdict': '{verdict}'}}")
    return "CASE " + " ".join(cases) + " END"


def _check() -> str:
    order, size = urls.ORDER, len(urls.ALPHABET) + 1
    steps = [f"p0 AS (SELECT gram, CAST({1.0 / size!r} AS DOUBLE) AS p_a, CAST({1.0 / size!r} AS DOUBLE) AS p_r FROM counts)"]
    for k in range(order + 1):
        key = f"substring(gram, {order + 1 - k}, {k + 1})"
        part = [f"CASE WHEN n_{c} > 0 THEN (k_{c} + t_{c} * p_{c}) / CAST(n_{c} + t_{c} AS DOUBLE) ELSE p_{c} END AS p_{c}"
                for c in "ar"]
        steps += [
            f"k{k} AS (SELECT {key} AS k, CAST(sum(a) AS BIGINT) AS k_a, CAST(sum(r) AS BIGINT) AS k_r FROM counts GROUP BY 1)",
            f"c{k} AS (SELECT left(k, {k}) AS c, CAST(sum(k_a) AS BIGINT) AS n_a, CAST(sum(k_r) AS BIGINT) AS n_r, "
            f"count(*) FILTER (WHERE k_a > 0) AS t_a, count(*) FILTER (WHERE k_r > 0) AS t_r FROM k{k} GROUP BY 1)",
            f"p{k + 1} AS (SELECT gram, {', '.join(part)} FROM p{k} JOIN k{k} ON k = {key} JOIN c{k} ON c = left(k, {k}))"]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH t AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) END AS rest FROM pages
), u AS (
    SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}'), '') AS host,
           regexp_extract(coalesce(rest, ''), '^[^?#]*') AS tail FROM t
), h AS (
    SELECT page_id, host, CASE WHEN strpos(tail, '/') > 0 THEN substring(tail, strpos(tail, '/')) ELSE '' END AS path FROM u
), j AS (
    SELECT page_id, host, path, {_rules_sql()} AS found,
           regexp_replace(translate(host || path, '{upper}{urls.DIGITS}', '{lower}{'0' * 10}'), '[^{urls.CLASS}]',
                          '{urls.FOREIGN}', 'g') AS seen FROM h
), r AS MATERIALIZED (
    SELECT j.*, found.rule AS rule, found.verdict AS given, left(md5(seen), 1) IN ({_aside()}) AS aside FROM j
), grams AS (
    SELECT substring(repeat('{urls.START}', {order}) || seen, pos, {order + 1}) AS gram, given, rule, aside
    FROM (SELECT *, unnest(range(1, length(seen) + 1)) AS pos FROM r)
), counts AS MATERIALIZED (
    SELECT gram, count(*) FILTER (WHERE rule IS NOT NULL AND NOT aside AND given = 'allow') AS a,
           count(*) FILTER (WHERE rule IS NOT NULL AND NOT aside AND given <> 'allow') AS r FROM grams GROUP BY 1
), {', '.join(steps)}, costs AS (
    SELECT gram, CAST(round((ln(p_a) - ln(p_r)) * {urls.MICRO}) AS BIGINT) AS delta FROM p{order + 1}
), scored AS (
    SELECT seen, CAST(floor(CAST(sum(delta) AS DOUBLE) / length(seen)) AS BIGINT) AS score
    FROM (SELECT seen, substring(repeat('{urls.START}', {order}) || seen, unnest(range(1, length(seen) + 1)), {order + 1}) AS gram
          FROM (SELECT DISTINCT seen FROM r)) JOIN costs USING (gram) GROUP BY seen
), s AS MATERIALIZED (SELECT r.*, coalesce(score, 0) AS score FROM r LEFT JOIN scored USING (seen)
), bins AS (
    SELECT CAST(floor(CAST(score AS DOUBLE) / {urls.BIN}) AS BIGINT) AS bin, count(*) FILTER (WHERE given = 'allow') AS a,
           count(*) FILTER (WHERE given <> 'allow') AS b FROM s WHERE rule IS NOT NULL AND aside GROUP BY 1
), whole AS (SELECT sum(a) AS a, sum(b) AS b FROM bins
), cuts AS (
    SELECT e.bin, CAST(sum(x.a) FILTER (WHERE x.bin >= e.bin) AS DOUBLE) / whole.a
                  + coalesce(CAST(sum(x.b) FILTER (WHERE x.bin < e.bin) AS DOUBLE), 0) / whole.b AS right_
    FROM bins e, bins x, whole WHERE whole.a > 0 AND whole.b > 0 GROUP BY e.bin, whole.a, whole.b
), cut AS (SELECT coalesce((SELECT bin FROM cuts ORDER BY right_ DESC, bin LIMIT 1), 0) * {urls.BIN} AS cut)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN rule IS NULL THEN score ELSE 0 END AS score
FROM s, cut
"""


def _aside() -> str:
    return ", ".join(f"'{x}'" for x in urls.ASIDE)


@query("op4_url_filter", _check())
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return urls.judge(table(spark, sf_dir, "pages"), RULES)
