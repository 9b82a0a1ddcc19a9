"""Drift events from a stream of captures.

Each micro-batch is compared with what the store knew when it arrived.  Inside one
batch, captures of a server count as arriving in ``arrival`` order.  The previous
capture of a new one is the newest by (scanned_at, scan_id) among all that arrived
before it, so a late capture is compared with that one and does not become the latest.

State is not kept in executor memory.  The newest capture of each server and its tools are two
tables in the shared folder, dealt over buckets of servers.  A micro-batch reads the buckets of
the servers that it names and writes these anew; all else it leaves alone, and versions that
nobody needs any more are removed.  What it wrote becomes visible with one small commit file
under its own id, so a lost executor, a restart or the same batch again changes nothing.  All
comparisons are joins and partial aggregates: no server, however busy, is handled by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rows import unnest
from ..operators.drift import events_of, pair_changes
from ..sources import files, store

HEADER = "server_id bigint, scan_id bigint, scanned_at timestamp"
TOOLS = "server_id bigint, scan_id bigint, pos int, name string, description string, input_schema string"
#: Captures of one server and batch that are put into one cell of arrival order.
CELL_WIDTH = 4096


def arrival_pairs(captures: DataFrame, known: DataFrame, width: int = CELL_WIDTH) -> DataFrame:
    """Each capture with the newest one that arrived before it.

    ``captures`` has (server_id, scan_id, scanned_at, arrival), ``known`` the latest
    header per server from earlier batches.  A running maximum over arrival order, in two
    levels: inside cells of ``width`` arrivals, and over one maximum per cell.
    """
    newest = F.struct("scanned_at", "scan_id")
    rows = captures.withColumn("_cell", F.floor(F.col("arrival") / width)).withColumn("_key", newest)
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("server_id", "_cell").orderBy("arrival", "scan_id").rowsBetween(*before)
    across = Window.partitionBy("server_id").orderBy("_cell").rowsBetween(*before)
    cells = (rows.groupBy("server_id", "_cell").agg(F.max("_key").alias("_top"))
             .withColumn("_earlier", F.max("_top").over(across)).drop("_top"))
    stored = known.select("server_id", newest.alias("_stored"))
    previous = F.greatest("_local", "_earlier", "_stored")
    return (rows.withColumn("_local", F.max("_key").over(inside))
            .join(cells, ["server_id", "_cell"]).join(stored, "server_id", "left")
            .select("server_id", "scan_id", "scanned_at", previous["scan_id"].alias("prev_scan_id")))


def process_batch(captures: DataFrame, tools: DataFrame, batch: int, path: str, buckets: int = store.BUCKETS) -> None:
    """Compare one micro-batch with the store and append it; a batch that is there already is left alone.

    ``captures`` has (server_id, scan_id, scanned_at, arrival); ``tools`` the tools table
    of the same captures.
    """
    spark = captures.sparkSession
    if store.read_commit(spark, path, batch) is not None:
        return
    earlier = [n for n in store.commit_numbers(spark, path) if n < batch]
    known = store.read_commit(spark, path, earlier[-1]) if earlier else None
    if known is not None:
        # What the batch before replaced: its readers have moved on by now.
        for folder in known.replaced:
            files.remove(spark, folder)

    rows = captures.withColumn("bucket", store.bucket_of(F.col("server_id"), buckets))
    named = sorted(r.bucket for r in rows.select("bucket").distinct().collect())
    heads = store.read_state(spark, path, "heads", HEADER, known, named)
    held = store.read_state(spark, path, "newest_tools", TOOLS, known, named)

    work = f"{path}/work/batch={batch}"
    arrival_pairs(captures, heads).write.mode("overwrite").parquet(f"{work}/pairs")
    pairs = spark.read.parquet(f"{work}/pairs")
    # A previous capture is one of this batch or the newest that is stored.
    own = rows.select("server_id", "scan_id").join(tools, "scan_id").select(*held.columns)
    every = own.unionByName(held)
    every.write.mode("overwrite").parquet(f"{work}/tools")
    every = spark.read.schema(TOOLS).parquet(f"{work}/tools")
    events = events_of(pair_changes(pairs, {"tools": every.drop("server_id").dropDuplicates(["scan_id", "pos"])}), pairs)

    newest = (heads.unionByName(rows.select(*heads.columns)).groupBy("server_id")
              .agg(F.max(F.struct("scanned_at", "scan_id")).alias("m")).select("server_id", "m.scan_id", "m.scanned_at")
              .withColumn("bucket", store.bucket_of(F.col("server_id"), buckets)))
    versions, replaced = dict(known.versions) if known else {}, []
    versions["heads"], gone = store.write_state(spark, path, "heads", newest, batch, known, named)
    replaced += gone
    newest = spark.read.schema(f"{HEADER}, bucket int").option("basePath", f"{path}/heads/version={batch}").parquet(f"{path}/heads/version={batch}")
    stay = every.dropDuplicates(["scan_id", "pos"]).join(newest.select("server_id", "scan_id", "bucket"), ["server_id", "scan_id"])
    versions["newest_tools"], gone = store.write_state(
        spark, path, "newest_tools", stay.select(*held.columns, "bucket"), batch, known, named)
    replaced += gone
    store.publish(spark, path, str(batch), {"drift_events": events}, batch, versions, replaced)
    files.remove(spark, work)


def drift_stream(captures: DataFrame, path: str, checkpoint: str, **trigger):
    """Start the stream.

    ``captures`` is a streaming DataFrame of (server_id, scan_id, scanned_at, arrival,
    tools), where ``tools`` is an array of (name, description, input_schema).  Returns the
    running query; read results with ``read_events``.
    """
    def run(frame: DataFrame, batch: int) -> None:
        frame = frame.persist()
        try:
            tools = unnest(frame, ["scan_id"], "tools", "t", "pos").select("scan_id", "pos", "t.*")
            process_batch(frame.drop("tools"), tools, batch, path)
        finally:
            frame.unpersist()

    options = trigger or {"availableNow": True}
    return (captures.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**options).start())


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All events recorded so far."""
    return store.read_table(spark, path, "drift_events").drop("day")
