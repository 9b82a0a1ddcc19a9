"""Quality classifier: the registered query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .quality import quality_scores
from .registry import query, table


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every whole document, learnt from the labels outside the held-out fold."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
