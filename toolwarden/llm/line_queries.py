"""Line dedup: the registered query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .lines import deduplicated
from .registry import query, table


@query("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after repeated and nearly repeated lines are removed from the corpus."""
    return deduplicated(table(spark, sf_dir, "documents"))
