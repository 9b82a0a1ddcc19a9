"""Where queries and the SQL they are checked against are registered."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Plain column types only, so results compare across engines.

    Integers become BIGINT, arrays of text one string, times microseconds.
    """
    columns = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("bigint")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.unix_micros(col.cast("timestamp"))
        elif isinstance(field.dataType, T.ArrayType):
            col = F.array_join(col, " ")
        elif isinstance(field.dataType, (T.MapType, T.StructType)):
            col = F.to_json(col)
        columns.append(col.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its check if there is one."""
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return flat(fn(configure(spark), sf_dir))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return register
