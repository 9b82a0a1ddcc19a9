"""Canonical manifests, their hashes, and baselines.

A capture is one row, and so is its canonical form: everything here up to the hash is row-local and never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.jsontext import json_quote, manifest_parts, nfc

BASELINE_COLUMNS = ("target", "server_name", "manifest_hash", "manifest", "rubric_version", "recorded_at")


def _json_object(*members: tuple[str, Column]) -> Column:
    parts: list[Column] = []
    for i, (key, value) in enumerate(members):
        parts += [F.lit(("," if i else "{") + f'"{key}":'), value]
    return F.concat(*parts, F.lit("}"))


def _json_array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _tool_json(tool: Column) -> Column:
    schema = tool["input_schema"]
    return F.concat(
        F.lit('{"name":'), json_quote(tool["name"]), F.lit(',"description":'), json_quote(tool["description"]),
        F.when(F.length(schema) > 0, F.concat(F.lit(',"input_schema":'), schema)).otherwise(F.lit("")),
        F.lit("}"))


def _resource_json(res: Column) -> Column:
    mime = res["mime_type"]
    return F.concat(
        F.lit('{"uri":'), json_quote(res["uri"]), F.lit(',"name":'), json_quote(res["name"]),
        F.lit(',"description":'), json_quote(res["description"]),
        F.when(mime != "", F.concat(F.lit(',"mime_type":'), json_quote(mime))).otherwise(F.lit("")), F.lit("}"))


def canonical_manifest(manifests: DataFrame) -> DataFrame:
    """Add ``canonical``: fixed field order, sorted lists, NFC text, canonical schemas."""
    server = _json_object(*[(key, json_quote(nfc(F.col(col)))) for key, col in (
        ("name", "server_name"), ("version", "server_version"), ("protocol_version", "protocol_version"))])
    prompts = F.transform(F.array_sort("canonical_prompts"), lambda p: _json_object(
        ("name", json_quote(p["name"])), ("description", json_quote(p["description"]))))
    schema = json_quote(F.col("schema_version")) if "schema_version" in manifests.columns else F.lit(f'"{C.MANIFEST_SCHEMA_VERSION}"')
    document = _json_object(
        ("schema_version", schema), ("server", server),
        ("tools", _json_array(F.transform(F.array_sort("canonical_tools"), _tool_json))),
        ("resources", _json_array(F.transform(F.array_sort("canonical_resources"), _resource_json))),
        ("prompts", _json_array(prompts)))
    return manifests.withColumn("canonical", document)


def manifest_hash(manifests: DataFrame) -> DataFrame:
    """Add ``manifest_hash``: hex SHA-256 of the canonical form."""
    if "canonical" not in manifests.columns:
        manifests = canonical_manifest(manifests)
    return manifests.withColumn("manifest_hash", F.sha2("canonical", 256))


def recorded_hash(baselines: DataFrame) -> DataFrame:
    """Add ``baseline_hash``: that of the canonical form of each recorded manifest.

    A manifest that already is the canonical text of itself hashes as it is.
    """
    columns = baselines.columns
    rows = baselines.select(*columns, F.get_json_object("manifest", "$.schema_version").alias("schema_version"),
                            manifest_parts(F.col("manifest")).alias("p"))
    parts = rows.select(*[F.struct(*columns).alias("_row")], F.coalesce("schema_version", F.lit(C.MANIFEST_SCHEMA_VERSION)).alias("schema_version"),
                        "p.*")
    # Without a tool list it is no manifest: its text stands for itself.
    text = F.when(F.col("canonical_tools").isNotNull(), F.col("canonical")).otherwise(F.col("_row.manifest"))
    return canonical_manifest(parts).select("_row.*", F.sha2(text, 256).alias("baseline_hash"))


def baseline_state(current: DataFrame, baselines: DataFrame) -> DataFrame:
    """first_scan, unchanged or drifted for each (target, manifest_hash) row.

    The baseline's hash is recomputed, not trusted: from the canonical form of its manifest, so
    spaces, key order and unnormalised text in a recorded document are no drift.
    """
    known = recorded_hash(baselines).select("target", "baseline_hash")
    state = (F.when(F.col("baseline_hash").isNull(), F.lit("first_scan"))
             .when(F.col("baseline_hash") == F.col("manifest_hash"), F.lit("unchanged"))
             .otherwise(F.lit("drifted")))
    return current.join(known, "target", "left").withColumn("baseline_state", state)


def put_baseline(current: DataFrame, baselines: DataFrame, update: bool = False) -> DataFrame:
    """The baseline table after a run.

    ``current`` has (target, server_name, canonical, scanned_at, scan_id).  A target
    without a baseline gets its first scan of the run; with ``update`` every scanned
    target gets its last.
    """
    order = F.struct("scanned_at", "scan_id")
    row = F.struct("server_name", F.sha2("canonical", 256).alias("manifest_hash"),
                   F.col("canonical").alias("manifest"),
                   F.lit(C.RUBRIC_VERSION).alias("rubric_version"), F.col("scanned_at").alias("recorded_at"))
    pick = F.max_by(row, order) if update else F.min_by(row, order)
    known = baselines.select("target")
    fresh = current if update else current.join(known, "target", "left_anti")
    put = fresh.groupBy("target").agg(pick.alias("b")).select("target", "b.*")
    kept = baselines.select(*BASELINE_COLUMNS)
    if update:
        kept = kept.join(put.select("target"), "target", "left_anti")
    return kept.unionByName(put.select(*BASELINE_COLUMNS))


def verify_gate(current: DataFrame, baselines: DataFrame) -> DataFrame:
    """One verdict row: error if a target has no baseline or failed, else drift, else ok.

    ``current`` has (target, manifest_hash); a NULL hash is a failed capture.
    """
    state = baseline_state(current, baselines)
    error = F.col("baseline_hash").isNull() | F.col("manifest_hash").isNull()
    totals = state.agg(
        F.count("*").alias("targets"), F.count_if(error).alias("errors"),
        F.count_if(~error & (F.col("baseline_state") == "drifted")).alias("drifted"))
    return totals.withColumn("verdict", F.when(F.col("errors") > 0, F.lit("error"))
                             .when(F.col("drifted") > 0, F.lit("drift")).otherwise(F.lit("ok")))
