"""Recording a batch of scans: servers, scans, findings, tools and drift, as one publication."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.drift import events_of, pair_changes
from ..operators.index import server_id
from ..session import cleaned
from ..sources import files, store
from ..sources.baselines import document_parts, part_tables
from ..streaming.drift_stream import arrival_pairs

#: The newest scan of each server, as it is kept to compare the next one with.
HEAD = "server_id bigint, scan_id bigint, scanned_at timestamp, manifest_hash string, manifest_json string"
#: Changes of a batch are looked for in slices of about so many scans, at most SLICES.
SLICE_SCANS = 1 << 14
SLICES = 16


@dataclass
class Reports:
    """What a batch of scans found.

    ``scans`` has (scan_id, source, identifier, canonical_url, registry, version, scanned_at,
    score, grade, manifest_hash, manifest_json) and, if there are, duration_ms, rubric_version
    and ``arrival``, the order in which the scans of a server count; by default that of
    their times.  ``findings`` are rows of the findings table, ``tools`` has (scan_id, name,
    description, input_schema, tokens).
    """

    scans: DataFrame
    findings: DataFrame
    tools: DataFrame
    tool_version: str = ""

    def rows(self, buckets: int) -> DataFrame:
        blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
        given = self.scans.columns
        extra = {"duration_ms": F.lit(0), "rubric_version": F.lit(C.RUBRIC_VERSION), "arrival": F.unix_micros("scanned_at")}
        server = server_id(F.col("source"), F.col("identifier"))
        return self.scans.select(
            F.col("scan_id").cast("bigint").alias("scan_id"), server.alias("server_id"),
            store.bucket_of(server, buckets).alias("bucket"), "source", "identifier", blank("canonical_url"),
            blank("registry"), blank("version"), F.col("scanned_at").cast("timestamp").alias("scanned_at"),
            F.lit(self.tool_version).alias("tool_version"), F.col("score").cast("int").alias("score"), "grade",
            "manifest_hash", "manifest_json",
            *[(F.col(c) if c in given else v).cast("int" if c == "rubric_version" else "bigint").alias(c) for c, v in extra.items()])


def written(spark: SparkSession, folder: str, rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` written to a folder and read back; what the write shuffled is removed with its end."""
    with cleaned(spark):
        rows.write.mode("overwrite").option("compression", store.CODEC).partitionBy(*by).parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def _events(spark: SparkSession, work: str, scans: DataFrame, heads: DataFrame, pairs: DataFrame) -> DataFrame:
    """The events of what changed in each pair.  Only manifests with different hashes are opened, each once for both of its roles.

    Servers are dealt over slices, which are compared one after the other: only the texts of a slice are moved at a time.
    """
    slices = min(SLICES, 1 + scans.count() // SLICE_SCANS)
    first = pairs.groupBy("scan_id").agg(F.min("server_id").alias("_first"))
    pairs = written(spark, f"{work}/linked", pairs.join(first, "scan_id").withColumn(
        "slice", F.pmod(F.xxhash64("_first"), F.lit(slices)).cast("int")).drop("_first"))
    columns = ["scan_id", "manifest_hash", "manifest_json"]
    stored = heads.join(scans.select("scan_id"), "scan_id", "left_anti")
    known = scans.select(*columns).unionByName(stored.select(*columns)).where("manifest_json IS NOT NULL")
    digest = known.groupBy("scan_id").agg(F.max("manifest_hash").alias("manifest_hash"))
    before = digest.withColumnsRenamed({"scan_id": "prev_scan_id", "manifest_hash": "_before"})
    other = written(spark, f"{work}/changed", pairs.where("prev_scan_id <> scan_id").select("scan_id", "prev_scan_id", "slice")
                    .join(before, "prev_scan_id").join(digest, "scan_id").where(~F.col("_before").eqNullSafe(F.col("manifest_hash"))))
    opened = other.select("slice", "scan_id", "manifest_hash").unionByName(
        other.select("slice", F.col("prev_scan_id").alias("scan_id"), F.col("_before").alias("manifest_hash"))).distinct()
    opened = opened.select("slice", F.col("scan_id").alias("_scan"), F.col("manifest_hash").alias("_hash"))
    texts = known.join(opened, (F.col("scan_id") == F.col("_scan")) & F.col("manifest_hash").eqNullSafe(F.col("_hash")))
    parts = written(spark, f"{work}/manifests", document_parts(
        texts.select("slice", "scan_id", F.col("manifest_json").alias("manifest"))), "slice")
    found = []
    for k in range(slices):
        mine = lambda rows: rows.where(F.col("slice") == k).drop("slice")  # noqa: B023, E731
        tables = part_tables(mine(parts))
        # A scan that was handed over twice has one header.
        tables["servers"] = tables["servers"].dropDuplicates(["scan_id"])
        changes = pair_changes(mine(other).select("scan_id", "prev_scan_id"), tables)
        found.append(written(spark, f"{work}/events-{k}", events_of(changes, mine(pairs))))
        files.remove(spark, f"{work}/manifests/slice={k}")
    return reduce(DataFrame.unionByName, found)


def _identified(rows: DataFrame, scans: DataFrame, *key: Column) -> DataFrame:
    """``rows`` of scans with an id, distinct within its scan, and the scan's time."""
    dated = rows.withColumn("id", F.xxhash64("scan_id", *key))
    return dated.join(scans.select("scan_id", "scanned_at"), "scan_id")


def record_scans(spark: SparkSession, path: str, batch: str, reports: Reports, buckets: int = store.BUCKETS) -> store.Commit:
    """Add a batch of scans to the store at ``path`` and return its commit.

    Servers are inserted or seen again, each scan is compared with the newest of its server that
    arrived before it, in this batch or an earlier one, and servers, scans, findings, tools and
    drift events appear together, with one commit.  Findings and tools of scans that are not in the
    batch are left out.  A batch of that name that is already there is
    returned as it is.  Work that fails before its commit leaves nothing that a reader sees and can
    be repeated; of two batches written at a time one ends with ``store.Conflict``.

    Read and written are the newest scans of those buckets that hold a server of the batch.
    """
    done = store.find_batch(spark, path, batch)
    if done is not None:
        return done
    known = store.last_commit(spark, path)
    number = known.number + 1 if known else 1
    if known:
        for folder in known.replaced:
            files.remove(spark, folder)
    work = f"{path}/work/{batch}"
    scans = written(spark, f"{work}/scans", reports.rows(buckets))
    named = sorted(r.bucket for r in scans.select("bucket").distinct().collect())
    heads = store.read_state(spark, path, "newest_scans", HEAD, known, named)
    pairs = written(spark, f"{work}/pairs", arrival_pairs(scans.select("server_id", "scan_id", "scanned_at", "arrival"), heads))
    linked = pairs.where("prev_scan_id IS NOT NULL")

    defs = reports.tools.select("scan_id", "name", "description", "input_schema", "tokens")
    parts = {
        "servers": scans.groupBy("source", "identifier").agg(
            F.max("server_id").alias("id"), F.max(F.when(F.col("canonical_url").isNotNull(), F.struct(
                "scanned_at", "canonical_url")))["canonical_url"].alias("canonical_url"),
            F.min(F.struct("scanned_at", "registry"))["registry"].alias("registry"), F.max("scanned_at").alias("seen_at")),
        "scans": scans.withColumnRenamed("scan_id", "id").drop("bucket", "source", "identifier", "canonical_url", "registry", "arrival"),
        "findings": _identified(store.finding_rows(reports.findings), scans, F.col("analyzer"), F.col("rule_id"), F.col("tool_name"),
                                F.col("title"), F.col("detail_json")),
        "tool_defs": _identified(store.tool_definitions(defs), scans, F.col("name"), F.col("description"), F.col("schema_json")),
        "drift_events": _events(spark, work, scans, heads, linked),
    }
    columns = ["server_id", "scan_id", "scanned_at", "manifest_hash", "manifest_json"]
    every = scans.select(*columns).unionByName(heads)
    top = every.groupBy("server_id").agg(F.max(F.struct("scanned_at", "scan_id")).alias("m")).select("server_id", "m.scan_id")
    newest = (every.dropDuplicates(["server_id", "scan_id"]).join(top, ["server_id", "scan_id"])
              .select(*columns, store.bucket_of(F.col("server_id"), buckets).alias("bucket")))
    held, gone = store.write_state(spark, path, "newest_scans", newest, number, known, named)
    versions = {**(known.versions if known else {}), "newest_scans": held}
    commit = store.publish(spark, path, batch, parts, number, versions, gone)
    files.remove(spark, work)
    return commit
