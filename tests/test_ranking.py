"""Positions and predecessors agree with plain windows, hot groups included."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from toolwarden.operators.ranking import previous_within, rank_within


def test_rank_within(spark):
    rng = random.Random(3)
    rows = [(1 if i % 3 else 2 + i % 7, rng.randint(0, 4), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v int, pos int")
    want = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "pos"))
    got = rank_within(df, ["k"], -F.col("v"), F.col("pos"), "rank", width=64).withColumn("want", want)
    assert got.where("rank <> want").count() == 0 and got.count() == 3000


def test_previous_within(spark):
    rng = random.Random(4)
    rows = [(1 if i % 3 else 2 + i % 5, rng.randint(0, 200), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, t int, id int")
    want = F.lag("id").over(Window.partitionBy("k").orderBy("t", "id"))
    coarse, fine = F.floor(F.col("t") / 10), F.struct("t", F.floor(F.col("id") / 100).alias("ids"))
    for cells in ([coarse], [fine, coarse], [fine, F.col("t"), coarse]):
        got = previous_within(df, ["k"], ["t", "id"], cells, F.col("id"), "prev").withColumn("want", want)
        assert got.columns == ["k", "t", "id", "prev", "want"]
        assert got.where("not (prev <=> want)").count() == 0 and got.count() == 3000


def test_scans_of_one_import(spark):
    """All scans of a server carry one time: they are cut by ranges of ids."""
    from toolwarden.operators.drift import scan_pairs

    scans = spark.range(3000).selectExpr("id", "1L AS server_id", "timestamp '2026-07-01 10:00:00' AS scanned_at")
    got = {r.scan_id: r.prev_scan_id for r in scan_pairs(scans, width=64).collect()}
    assert got == {i: i - 1 if i else None for i in range(3000)}
