"""Benchmark decontamination: the registered query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontamination import contamination
from .registry import query, table


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it contains."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
