"""Captured list results of servers as manifest tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsontext import capture_parts
from ..functions.rows import unnest

CAPTURE_SCHEMA = (
    "scan_id bigint, source string, identifier string, scanned_at timestamp, "
    "initialize string, tools_list string, resources_list string, prompts_list string"
)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captures from JSON lines.  Results may be nested objects: they are kept as source text."""
    return spark.read.schema(CAPTURE_SCHEMA).json(path)


def ingest_manifests(captures: DataFrame, canonical: bool = True) -> DataFrame:
    """One row per capture with its lists as arrays, in captured and canonical form.

    Messages are read whole, whatever their length, and decoded once; names of members count in
    any case.  A missing or malformed tool list is a failed capture: its row carries ``error`` and
    no tools.  Missing or malformed resources and prompts are just empty.  Without ``canonical`` the
    canonical lists are NULL: only hashing needs them.
    """
    rows = captures.select(
        "scan_id", "source", "identifier", "scanned_at", F.col("tools_list").isNull().alias("early"),
        capture_parts(F.col("initialize"), F.col("tools_list"), F.col("resources_list"), F.col("prompts_list"), canonical).alias("p"))
    rows = rows.select("scan_id", "source", "identifier", "scanned_at", "p.*", "early")
    return rows.withColumn("error", F.when(F.col("early"), F.lit("no tools result")).when(
        F.col("tools").isNull(), F.lit("tools result is not a tool list"))).drop("early")


def captured(manifests: DataFrame) -> DataFrame:
    """The captures that worked."""
    return manifests.where(F.col("error").isNull())


def failed(manifests: DataFrame) -> DataFrame:
    return manifests.where(F.col("error").isNotNull())


def tools_table(manifests: DataFrame) -> DataFrame:
    """One row per tool: (scan_id, pos, name, description, input_schema); failed captures have none."""
    return unnest(manifests, ["scan_id"], "tools", "t", "pos").select("scan_id", "pos", "t.*")


def resources_table(manifests: DataFrame) -> DataFrame:
    return unnest(captured(manifests), ["scan_id"], "resources", "r", "pos").select("scan_id", "pos", "r.*")


def prompts_table(manifests: DataFrame) -> DataFrame:
    return unnest(captured(manifests), ["scan_id"], "prompts", "p", "pos").select("scan_id", "pos", "p.*")


def servers_table(manifests: DataFrame) -> DataFrame:
    return captured(manifests).select("scan_id", "server_name", "server_version", "protocol_version")


def manifest_tables(manifests: DataFrame) -> dict[str, DataFrame]:
    """The per-scan tables the drift operators take."""
    return {"tools": tools_table(manifests), "servers": servers_table(manifests),
            "resources": resources_table(manifests), "prompts": prompts_table(manifests)}
