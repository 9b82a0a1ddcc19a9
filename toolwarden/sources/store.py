"""The relational store: plain Parquet folders, published batch by batch.

A batch writes each of its tables aside, into folders of its own, and then one small commit file
that names them.  The commit appears at once and only if no other has its number, so readers,
who start from the commits, see all of a batch or nothing of it, whatever fails or runs at the
same time; a batch that is already there is not written again.

    <table>/commit=<number>-<attempt>/day=<first of a month>/*.parquet     rows of one batch, never changed
    <table>/version=<number>/bucket=<bucket>/*.parquet         newest rows of the servers of a bucket
    commits/<number>.json                                      what belongs to the store
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cleaned
from . import files

#: Tables of the store and the time that dates their rows.
TABLES = {
    "servers": "seen_at",
    "scans": "scanned_at",
    "findings": "scanned_at",
    "tool_defs": "scanned_at",
    "drift_events": "detected_at",
}
SCHEMAS = {
    "servers": "id bigint, source string, identifier string, canonical_url string, registry string, seen_at timestamp",
    "scans": ("id bigint, server_id bigint, version string, scanned_at timestamp, tool_version string, rubric_version int, "
              "score int, grade string, manifest_hash string, duration_ms bigint, manifest_json string"),
    "findings": ("id bigint, scan_id bigint, analyzer string, rule_id string, severity string, title string, "
                 "detail_json string, tool_name string, scanned_at timestamp"),
    "tool_defs": ("id bigint, scan_id bigint, name string, description string, schema_json string, "
                  "token_count_by_model_json string, scanned_at timestamp"),
    "drift_events": ("id bigint, server_id bigint, from_scan_id bigint, to_scan_id bigint, kind string, target string, "
                     "severity string, diff_json string, detected_at timestamp"),
}
#: Manifests and descriptions are most of a store; this takes two thirds of Spark's default.
CODEC = "zstd"
#: In what order the rows of a month are written, where neighbours share texts.
ORDERS = {"drift_events": ["server_id", "detected_at", "to_scan_id"]}
#: Servers are dealt over this many buckets; a batch reads and writes only those of its servers.
BUCKETS = 256


class Conflict(RuntimeError):
    """Another batch was published meanwhile; run this one again."""


class Commit(NamedTuple):
    """One published batch: its folders by table, and by state table and bucket the version that holds it."""

    number: int
    batch: str
    folders: dict[str, str]
    versions: dict[str, dict[str, int]]
    replaced: list[str]


def tool_definitions(tools: DataFrame) -> DataFrame:
    """Tools with ``tokens`` as stored rows; the token counts are one JSON column."""
    return tools.select(
        "scan_id", "name", "description", F.nullif("input_schema", F.lit("")).alias("schema_json"),
        F.to_json(F.struct(F.col("tokens").alias("representative"))).alias("token_count_by_model_json"))


def finding_rows(findings: DataFrame) -> DataFrame:
    """Findings as stored rows: long texts go into one JSON column, blank tools become NULL."""
    return findings.select(
        "scan_id", "analyzer", "rule_id", "severity", "title",
        F.to_json(F.struct(F.coalesce("detail", F.lit("")).alias("detail"),
                           F.coalesce("remediation", F.lit("")).alias("remediation"), "meta")).alias("detail_json"),
        F.nullif("tool", F.lit("")).alias("tool_name"))


# --- commits ---------------------------------------------------------------------

def commit_numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in files.names(spark, f"{path}/commits") if n.endswith(".json"))


def read_commit(spark: SparkSession, path: str, number: int) -> Commit | None:
    text = files.read_text(spark, f"{path}/commits/{number:012}.json")
    return None if text is None else Commit(**json.loads(text))


def last_commit(spark: SparkSession, path: str) -> Commit | None:
    numbers = commit_numbers(spark, path)
    return read_commit(spark, path, numbers[-1]) if numbers else None


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """All commits in order; what is read is one line per batch."""
    if not commit_numbers(spark, path):
        return []
    rows = spark.read.text(f"{path}/commits/*.json", wholetext=True).collect()
    return sorted((Commit(**json.loads(r.value)) for r in rows), key=lambda c: c.number)


def find_batch(spark: SparkSession, path: str, batch: str) -> Commit | None:
    return next((c for c in commits(spark, path) if c.batch == batch), None)


# --- history tables ----------------------------------------------------------------

def publish(spark: SparkSession, path: str, batch: str, parts: dict[str, DataFrame], number: int | None = None,
            versions: dict[str, dict[str, int]] | None = None, replaced: Iterable[str] = ()) -> Commit:
    """Write the tables of a batch aside and make them part of the store with one commit.

    ``number`` is the commit's place, by default the next one.  Folders are partitioned by month, named by
    its first day, so a reader of some days opens their months only, and a batch that spans many years
    doesn't become a file for each day.  A ``Conflict`` leaves nothing that any reader sees.
    """
    if number is None:
        number = (commit_numbers(spark, path) or [0])[-1] + 1
    folders = {}
    for name, rows in parts.items():
        folders[name] = f"commit={number}-{uuid.uuid4().hex}"
        dated = rows.withColumn("day", F.trunc(TABLES[name], "month")) if name in TABLES else rows.withColumn("day", F.lit(None).cast("date"))
        # Many small files or one task for all of a month: neither.
        with cleaned(spark):
            dated.hint("rebalance", "day").sortWithinPartitions("day", *ORDERS.get(name, [])).write.partitionBy("day").option(
                "compression", CODEC).parquet(f"{path}/{name}/{folders[name]}")
    commit = Commit(number, batch, folders, versions or {}, list(replaced))
    if not files.publish(spark, f"{path}/commits/{number:012}.json", json.dumps(commit._asdict(), sort_keys=True)):
        raise Conflict(f"commit {number} of {path} is taken; run batch {batch!r} again")
    return commit


def read_table(spark: SparkSession, path: str, name: str, since: dt.date | None = None) -> DataFrame:
    """One stored table over all committed batches, with its ``day``; the months before ``since`` aren't opened.

    The folders are those that the commits named when this was called: batches that are published
    later, and rows of a batch that never was, are not in it.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return read_folders(spark, path, name, SCHEMAS[name], [c.folders[name] for c in commits(spark, path) if name in c.folders], since)


def read_folders(spark: SparkSession, path: str, name: str, schema: str, folders: list[str], since: dt.date | None = None) -> DataFrame:
    wanted = [f"{path}/{name}/{f}" for f in folders if files.names(spark, f"{path}/{name}/{f}")]
    whole = f"{schema}, day date"
    if not wanted:
        return spark.createDataFrame([], whole)
    rows = spark.read.schema(whole).option("basePath", f"{path}/{name}").parquet(*wanted)
    if since:
        rows = rows.where(F.col("day") >= F.lit(since.replace(day=1)))
    rows = rows.withColumn("day", F.to_date(TABLES[name])).select(*spark.createDataFrame([], whole).columns)
    return rows.where(F.col("day") >= F.lit(since)) if since else rows


def read_servers(spark: SparkSession, path: str) -> DataFrame:
    """The server table: each server once, with when it was first and last seen.

    The registry is the one first written; of the addresses the last that isn't NULL counts.
    """
    seen = read_table(spark, path, "servers")
    named = F.when(F.col("canonical_url").isNotNull(), F.struct("seen_at", "canonical_url"))
    return seen.groupBy("id", "source", "identifier").agg(
        F.max(named)["canonical_url"].alias("canonical_url"), F.min(F.struct("seen_at", "registry"))["registry"].alias("registry"),
        F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


def remove_unpublished(spark: SparkSession, path: str) -> list[str]:
    """Remove what failed batches left behind, and return the folders.  Not while a batch is being written."""
    named = {f"{path}/{name}/{folder}" for c in commits(spark, path) for name, folder in c.folders.items()}
    gone = []
    for name in TABLES:
        for folder in files.names(spark, f"{path}/{name}"):
            if folder.startswith("commit=") and f"{path}/{name}/{folder}" not in named:
                files.remove(spark, f"{path}/{name}/{folder}")
                gone.append(f"{path}/{name}/{folder}")
    return gone


# --- state by bucket -----------------------------------------------------------------

def bucket_of(server: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(server), F.lit(buckets)).cast("int")


def state_folders(path: str, name: str, commit: Commit | None, buckets: Iterable[int]) -> list[str]:
    """The folders that hold the newest rows of some buckets: nothing else is opened."""
    held = commit.versions.get(name, {}) if commit else {}
    return [f"{path}/{name}/version={held[str(b)]}/bucket={b}" for b in buckets if str(b) in held]


def read_state(spark: SparkSession, path: str, name: str, schema: str, commit: Commit | None, buckets: Iterable[int]) -> DataFrame:
    folders = state_folders(path, name, commit, buckets)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def write_state(spark: SparkSession, path: str, name: str, rows: DataFrame, number: int, commit: Commit | None,
                buckets: Iterable[int]) -> tuple[dict[str, int], list[str]]:
    """New rows of some buckets (in column ``bucket``) as a version; no reader sees it before its commit.

    Returns where each bucket's rows are from now on, and the folders that this replaces.
    """
    buckets = list(buckets)
    folder = f"{path}/{name}/version={number}"
    with cleaned(spark):
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").option("compression", CODEC).parquet(folder)
    held = dict(commit.versions.get(name, {})) if commit else {}
    for b in buckets:
        held.pop(str(b), None)
    for found in files.names(spark, folder):
        if found.startswith("bucket="):
            held[found.removeprefix("bucket=")] = number
    return held, state_folders(path, name, commit, buckets)
