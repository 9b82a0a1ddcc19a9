"""Periodic runs: the registered query and its check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runs
from .registry import query, table

WORD = r"[^\x20\x09-\x0D]+"


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document, by the hash of its id, ends in a loop of some of its words."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    rows = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("g", F.expr("h div 10"))
            .withColumn("words", F.when(F.col("h") % 10 == 0, words))
            .withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.expr("int(g % n)")))
            .withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))")))
    loop = F.expr("""array_join(slice(concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, p),
                     int(ceil((n - a) / p))))), 1, n), ' ')""")
    return rows.select("doc_id", F.when(F.col("n") > 0, loop).otherwise(F.col("text")).alias("text"))


#: CRC-32 bit by bit, as the other engine has none: eight shifts for each digit of the id.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))"""

PERIODIC_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words
    FROM documents),
sized AS (SELECT *, len(words) AS n, (h // 10) % len(words) AS a, h // 10 AS g FROM docs),
looped AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM sized),
texts AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n),
    lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE words END AS words FROM looped),
placed AS (SELECT r, n, unnest(range(0, n)) AS i, unnest(words) AS word FROM texts),
squares AS (SELECT x.r, y.i - x.i AS q, y.i AS t FROM placed x JOIN placed y
    ON x.r = y.r AND x.word = y.word AND y.i > x.i AND {runs.LEAST_PERIODS} * (y.i - x.i) <= x.n),
steps AS (SELECT *, t - row_number() OVER (PARTITION BY r, q ORDER BY t) AS island FROM squares),
stretches AS (SELECT r, q, min(t) - q AS start, count(*) + q AS length FROM steps GROUP BY r, q, island
    HAVING count(*) + q >= greatest({runs.LEAST_WORDS}, {runs.LEAST_PERIODS} * q)),
found AS (SELECT * FROM stretches s WHERE NOT EXISTS (SELECT 1 FROM stretches o WHERE o.r = s.r AND o.q < s.q
    AND o.start <= s.start AND o.start + o.length >= s.start + s.length)),
totals AS (SELECT r, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'q': q}}, (-length, start, q)) AS top,
    string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM found GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM found),
left_over AS (SELECT p.r, string_agg(word, ' ' ORDER BY p.i) AS collapsed FROM placed p
    LEFT JOIN dropped d ON d.r = p.r AND d.i = p.i WHERE d.i IS NULL GROUP BY p.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.q AS period,
    1000 * top.l // top.q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
    sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM texts t LEFT JOIN totals o ON o.r = t.r LEFT JOIN left_over l ON l.r = t.r"""


@query("op12_periodic_runs", PERIODIC_SQL)
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole document, its longest one, and digests of all runs and of the collapsed text."""
    found = runs.with_runs(with_loops(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda x: F.struct(
        (-x["length"]).alias("less"), x["start"].alias("start"), x["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda x: F.concat(
        F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("top"),
                        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("top.start").alias("start"), (-F.col("top.less")).alias("length"),
        F.col("top.period").alias("period"),
        F.floor(1000 * -F.col("top.less") / F.col("top.period")).cast("bigint").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")
