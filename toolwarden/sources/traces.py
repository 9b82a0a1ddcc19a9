"""System-call logs as observed behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C

#: What a run was seen doing, and the column that lists the first of each.
KINDS = {"decoy": "decoy_reads", "egress": "egress_hosts", "dns": "dns_resolve"}
#: So many paths or addresses of a run are listed in one row; how many there are besides is a number.
LISTED = 1000


def _logs(spark: SparkSession, path: str) -> DataFrame:
    name = F.col("_metadata.file_name")
    scan = F.regexp_extract(name, r"^(\d+)\.[^.]*$", 1).try_cast("bigint")
    return spark.read.text(path).select(scan.alias("scan_id"), F.col("value").alias("line"), name.alias("file"))


def read_trace_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with the scan id taken from the file name, ``<scan_id>.log``; see ``rejected_logs``."""
    return _logs(spark, path).where("scan_id IS NOT NULL").drop("file")


def rejected_logs(spark: SparkSession, path: str) -> DataFrame:
    """Files that belong to no scan, with the reason: (file, lines, reason)."""
    odd = _logs(spark, path).where("scan_id IS NULL")
    return odd.groupBy("file").agg(F.count("*").alias("lines"), F.lit("the file name is no scan id").alias("reason"))


def observations(lines: DataFrame) -> DataFrame:
    """What each scan was seen doing, one row per thing: (scan_id, kind, what).

    Lines are classified one by one.  Rows are made distinct by all three columns, so what one
    run did, a million addresses or more, is dealt over all tasks.
    """
    line = F.col("line")
    opened = line.contains("openat(") | line.contains("open(")
    reads = F.when(opened, F.array_compact(F.array(*[F.when(line.contains(p), F.lit(p)) for p in C.DECOY_PATHS])))
    calls = F.transform(
        F.arrays_zip(F.regexp_extract_all(line, F.lit(C.CONNECT_PATTERN), F.lit(1)).alias("port"),
                     F.regexp_extract_all(line, F.lit(C.CONNECT_PATTERN), F.lit(2)).alias("addr")),
        lambda m: F.struct(
            F.concat(m["addr"], F.lit(":"), m["port"]).alias("what"),
            F.when((m["addr"] == "127.0.0.53") | (m["port"] == "53"), F.lit("dns"))
            .when(~m["addr"].startswith("127."), F.lit("egress")).alias("kind")))
    decoys = F.transform(F.coalesce(reads, F.array().cast("array<string>")),
                         lambda p: F.struct(p.alias("what"), F.lit("decoy").alias("kind")))
    return (lines.where(line.contains("connect(") | opened)
            .select("scan_id", F.explode_outer(F.concat(decoys, calls)).alias("x"))
            .where(F.col("x.kind").isNotNull()).select("scan_id", "x.kind", "x.what").distinct())


def trace_behavior(lines: DataFrame, runs: DataFrame | None = None, listed: int = LISTED) -> DataFrame:
    """One row per scan: the first ``listed`` decoy reads, egress and lookups in order, and how many more.

    ``runs`` (scan_id, net_denied and, optionally, unobserved) adds scans whose log is empty.  Without
    it nobody knows whether the network was denied, and ``net_denied`` is NULL.
    """
    seen = observations(lines)
    # Each task keeps its first ``listed`` of a scan and kind before anything is shuffled.
    place = F.row_number().over(Window.partitionBy("scan_id", "kind").orderBy("what"))
    first = seen.withColumn("_n", place).where(F.col("_n") <= listed)
    lists = first.groupBy("scan_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("what")))).alias(name) for kind, name in KINDS.items()])
    counts = seen.groupBy("scan_id").agg(*[
        F.count_if(F.col("kind") == kind).alias(f"n_{name}") for kind, name in KINDS.items()])
    known = runs if runs is not None else lines.select("scan_id").distinct().withColumn("net_denied", F.lit(None).cast("boolean"))
    none = F.array().cast("array<string>")
    rows = known.join(lists, "scan_id", "left").join(counts, "scan_id", "left")
    if "unobserved" not in known.columns:
        rows = rows.withColumn("unobserved", F.lit(""))
    return rows.select("scan_id", *[F.coalesce(c, none).alias(c) for c in KINDS.values()], "net_denied", "unobserved",
                       *[F.greatest(F.coalesce(f"n_{c}", F.lit(0)) - listed, F.lit(0)).alias(f"more_{c}") for c in KINDS.values()])
