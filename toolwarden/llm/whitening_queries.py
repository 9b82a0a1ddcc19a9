"""Embedding whitening: the registered query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .whitening import whiten


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on up to 32 whitened components, one row per vector and component."""
    rows = whiten(table(spark, sf_dir, "embeddings"), 32, 64, 1_000_000)
    return (rows.select("*", F.posexplode("whitened").alias("place", "value"))
            .select(F.col("vec_id").cast("bigint").alias("vec_id"), (F.col("place") + 1).alias("component"), "n",
                    F.col("deviation").cast("bigint").alias("deviation"), F.col("value").alias("whitened"),
                    F.col("explained")[F.col("place")].alias("explained"), "identity_error"))
