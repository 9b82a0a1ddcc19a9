"""Queries that run the streaming jobs over the given tables until all input is consumed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import drift_stream as stream
from ..streaming import rates
from . import bridge as B
from . import checks as K
from .drift_queries import _EVENT_SEVERITY, HISTORY, history
from .registry import query


def _captures(spark, sf):
    """The history of documents as captures, arriving in time order."""
    scans, tools = history(spark, sf)
    lists = tools.groupBy("scan_id").agg(F.array_sort(F.collect_list(
        F.struct("pos", "name", "description", "input_schema"))).alias("t"))
    item = lambda t: F.struct(t["name"].alias("name"), t["description"].alias("description"),
                              t["input_schema"].alias("input_schema"))
    return scans.join(lists, scans["id"] == lists["scan_id"]).select(
        "server_id", "scan_id", "scanned_at", F.col("id").alias("arrival"), F.transform("t", item).alias("tools"))


@query("drift_stream", HISTORY + f""" SELECT p.prev AS from_scan_id, p.id AS to_scan_id, kind, target,
  {_EVENT_SEVERITY} AS severity FROM changes c JOIN pairs p ON p.id = c.id""")
def drift_stream(spark, sf):
    """Captures arrive as files, three micro-batches in time order; events as recorded."""
    root = shared_dir(spark, "drift-stream")
    rows = _captures(spark, sf)
    bounds = rows.agg(F.percentile_approx("arrival", [1 / 3, 2 / 3], 10000).alias("b")).first()["b"]
    part = F.when(F.col("arrival") <= bounds[0], 0).when(F.col("arrival") <= bounds[1], 1).otherwise(2)
    staged = rows.withColumn("part", part)
    staged.write.partitionBy("part").parquet(f"{root}/staged")
    schema = rows.schema
    for i in range(3):
        piece = spark.read.schema(schema).parquet(f"{root}/staged/part={i}")
        piece.write.mode("append").parquet(f"{root}/arrivals")
        source = spark.readStream.schema(schema).parquet(f"{root}/arrivals")
        stream.drift_stream(source, f"{root}/store", f"{root}/checkpoint").awaitTermination()
    return stream.read_events(spark, f"{root}/store").select(
        "from_scan_id", "to_scan_id", "kind", "target", "severity")


@query("drift_rate_30d", f"""WITH {K.DRIFT_ROWS.strip()},
  daily AS (SELECT date_trunc('day', detected_at) AS day, severity, count(*) AS events FROM drift GROUP BY 1, 2),
  starts AS (SELECT *, unnest(generate_series(CAST(day AS TIMESTAMP) - INTERVAL 29 DAYS, CAST(day AS TIMESTAMP), INTERVAL 1 DAY)) AS s
    FROM daily)
  SELECT epoch_us(s) AS start, epoch_us(s + INTERVAL 30 DAYS) AS "end", severity, CAST(sum(events) AS BIGINT) AS events
  FROM starts GROUP BY 1, 2, 3""")
def drift_rate_30d(spark, sf):
    """Daily counts of each micro-batch of a stream, then 30-day sums."""
    root = shared_dir(spark, "drift-rate")
    B.index_events(spark, sf).write.parquet(f"{root}/events")
    events = spark.readStream.schema(spark.read.parquet(f"{root}/events").schema).parquet(f"{root}/events")
    rates.drift_rate_stream(events, root, f"{root}/checkpoint").awaitTermination()
    return rates.rolling(rates.read_daily(spark, root))
