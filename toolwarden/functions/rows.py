"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list, array: Column | str, name: str, pos: str | None = None) -> DataFrame:
    """One row per non-NULL element of ``array``, with the columns ``keep`` and its position.

    The outer form of explode is on purpose.  For the plain one the optimizer infers a
    filter on the array and pushes it below the projection that computes it, so costly
    arrays (parsed JSON, detector results) would be computed two or three times.
    """
    items = F.explode_outer(array).alias(name) if pos is None else F.posexplode_outer(array).alias(pos, name)
    return df.select(*keep, items).where(F.col(name).isNotNull())
