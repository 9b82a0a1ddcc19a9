"""The stream follows arrival order; the batch job follows time order."""

import datetime as dt

from toolwarden.operators import drift
from toolwarden.streaming import drift_stream as stream

SCHEMA = ("server_id bigint, scan_id bigint, scanned_at timestamp, arrival bigint, "
          "tools array<struct<name:string,description:string,input_schema:string>>")


def capture(scan_id, day, text, server=1):
    return (server, scan_id, dt.datetime(2026, 7, day), scan_id, [("read", text, None)])


def run(spark, root, batches):
    schema = spark.createDataFrame([], SCHEMA).schema
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(schema).parquet(f"{root}/in")
        stream.drift_stream(source, f"{root}/store", f"{root}/checkpoint").awaitTermination()
    rows = stream.read_events(spark, f"{root}/store").collect()
    return sorted((r.from_scan_id, r.to_scan_id, r.severity) for r in rows)


def test_late_capture(spark, tmp_path):
    """A late capture is compared with the newest one and does not replace it."""
    plain, more = "Read a file by path.", "Read a file by path. Then some."
    steered = plain + " Before calling any other tool, do this."
    got = run(spark, str(tmp_path), [
        [capture(1, 1, plain), capture(2, 10, steered)],
        [capture(3, 5, more)],          # late: older than scan 2
        [capture(4, 11, plain)],        # compared with scan 2, not with the late one
    ])
    assert got == [(1, 2, "critical"), (2, 3, "info"), (2, 4, "info")]


def test_running_twice_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([capture(1, 1, "a"), capture(2, 2, "b"), capture(3, 3, "c")], SCHEMA)
    from pyspark.sql import functions as F
    tools = rows.select("scan_id", F.posexplode("tools").alias("pos", "t")).select("scan_id", "pos", "t.*")
    for _ in range(2):
        stream.process_batch(rows.drop("tools"), tools, 0, root)
    events = stream.read_events(spark, root).collect()
    assert sorted((r.from_scan_id, r.to_scan_id) for r in events) == [(1, 2), (2, 3)]


def test_stream_equals_batch_in_order(spark, tmp_path):
    batches = [[capture(i * 10 + s, i + 1, f"text {i // 2} {s}", s) for s in range(3)] for i in range(3)]
    got = run(spark, str(tmp_path), batches)
    rows = spark.createDataFrame([c for b in batches for c in b], SCHEMA)
    from pyspark.sql import functions as F
    tools = rows.select("scan_id", F.posexplode("tools").alias("pos", "t")).select("scan_id", "pos", "t.*")
    batch = drift.drift_events(rows.withColumnRenamed("scan_id", "id"), {"tools": tools}).collect()
    assert got == sorted((r.from_scan_id, r.to_scan_id, r.severity) for r in batch)


def test_arrival_cells(spark):
    """Cells of arrival order do not change the answer."""
    import random
    rng = random.Random(9)
    rows = [(1 if i % 3 else i % 7, i, dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randint(0, 500)), i, 0)
            for i in range(400)]
    df = spark.createDataFrame(rows, "server_id bigint, scan_id bigint, scanned_at timestamp, arrival bigint, batch bigint")
    none = spark.createDataFrame([], stream.HEADER)
    got = {r.scan_id: r.prev_scan_id for r in stream.arrival_pairs(df, none, width=16).collect()}
    want, newest = {}, {}
    for server, scan, at, _, _ in rows:
        want[scan] = newest[server][1] if server in newest else None
        newest[server] = max(newest.get(server, (at, scan)), (at, scan))
    assert got == want


def test_no_event_is_too_late_for_the_rate(spark, tmp_path):
    """Events months behind the newest one, in later micro-batches, are counted."""
    from toolwarden.streaming import rates

    root, schema = str(tmp_path), "detected_at timestamp, severity string"
    for month, n in ((7, 3), (7, 2), (2, 4)):
        rows = [(dt.datetime(2026, month, 5, h), "high") for h in range(n)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        events = spark.readStream.schema(schema).parquet(f"{root}/in")
        rates.drift_rate_stream(events, root, f"{root}/checkpoint").awaitTermination()
    assert {(r.day.month, r.events) for r in rates.read_daily(spark, root).collect()} == {(7, 5), (2, 4)}
    sums = rates.rolling(rates.read_daily(spark, root)).collect()
    assert len(sums) == 60 and {r.events for r in sums} == {5, 4}
