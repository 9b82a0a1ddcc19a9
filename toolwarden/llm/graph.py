"""Connected components of any size by contraction, with lineage cut in every round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import kept


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b): the smallest id that links lead to.

    Each round every node moves to its smallest neighbour, or stays if it is smaller, and the
    edges follow.  At least half of the nodes that still have edges merge in a round, so the
    rounds are few and their tables shrink; the moves are composed in the end.  Minima are
    aggregated before they are shuffled, and joins have stored tables on either side, so Spark
    can split the rows of a node with many links.
    """
    left = kept(edges.where("a <> b").select("a", "b").distinct(), "links")
    moves = []
    while not moves or not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves.append(kept(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "moves"))
        ends = [moves[-1].select(F.col("id").alias(c), F.col("to").alias(f"_{c}")) for c in "ab"]
        moved = left.join(ends[0], "a").join(ends[1], "b").where("_a <> _b")
        left = kept(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "links")

    def follow(done: DataFrame, move: DataFrame) -> DataFrame:
        move = move.select(F.col("id").alias("component"), "to")
        return done.join(move, "component", "left").select("id", F.coalesce("to", "component").alias("component"))

    return reduce(follow, moves[1:], moves[0].select("id", F.col("to").alias("component")))
