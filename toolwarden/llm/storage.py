"""Cutting lineage: tables written to the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import CLEANUP, cleaned, shared_dir  # noqa: F401
from ..sources import files


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Lost executors cost nothing after this point, later steps see one fixed result, and the
    columns carry no lineage.  What the write shuffled is removed with its end.
    """
    path = shared_dir(df.sparkSession, purpose)
    with cleaned(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Remove tables that ``kept`` wrote, once nothing reads them any more."""
    for df in frames:
        files.remove(df.sparkSession, df._kept)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df``."""
    while name in df.columns:
        name = f"_{name}"
    return name
