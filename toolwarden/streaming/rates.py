"""Rolling drift-event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW, STEP = "30 days", "1 day"


def drift_rate_30d(events: DataFrame) -> DataFrame:
    """Events per day and severity, of a table or a micro-batch.

    Events are first counted per day, so a row enters one window instead of thirty; the
    thirty-fold fan-out happens on one row per day and severity, in ``rolling``.
    """
    return (events.groupBy(F.window("detected_at", STEP).alias("day"), "severity")
            .agg(F.count("*").alias("events"))
            .select(F.col("day.start").alias("day"), "severity", "events"))


def drift_rate_stream(events: DataFrame, path: str, checkpoint: str, **trigger):
    """Start the stream of daily counts; returns the running query, read results with ``read_daily``.

    Each micro-batch is counted by itself and written under its own id, replaced as a whole when
    it is run again.  There is no watermark, so no event is too late to count.
    """
    def run(frame: DataFrame, batch: int) -> None:
        drift_rate_30d(frame).write.mode("overwrite").parquet(f"{path}/daily/batch={batch}")

    options = trigger or {"availableNow": True}
    return (events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**options).start())


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """Daily counts over all micro-batches so far."""
    return (spark.read.option("basePath", f"{path}/daily").parquet(f"{path}/daily").groupBy("day", "severity")
            .agg(F.sum("events").alias("events")))


def rolling(daily: DataFrame) -> DataFrame:
    """30-day sums from daily counts: one row per window and severity."""
    return (daily.groupBy(F.window("day", WINDOW, STEP).alias("w"), "severity")
            .agg(F.sum("events").alias("events"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "severity", "events"))
