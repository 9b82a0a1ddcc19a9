"""Capabilities a server declares and those it was seen using."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import detect
from ..functions.jsontext import schema_property_names
from ..functions.rows import unnest
from .injection import with_text
from .findings import SERVER_SEQ, TOOL_STRIDE, explode_findings, finding


def with_properties(tools: DataFrame) -> DataFrame:
    """Add ``schema_properties`` unless ingestion already did.

    Only schemas that contain a deciding word are handed to Python.
    """
    if "schema_properties" in tools.columns:
        return tools
    schema = F.col("input_schema")
    return tools.withColumn("schema_properties", schema_property_names(schema, detect.schema_matters(schema)))


def classify_tools(tools: DataFrame) -> DataFrame:
    """Add ``classes``: the sorted capability classes of each tool."""
    if "classes" in tools.columns:
        return tools
    classes = detect.capability_classes(F.col("_lower"), F.col("schema_properties"))
    rows = with_text(with_properties(tools)).withColumn("classes", classes)
    return rows if "_lower" in tools.columns else rows.drop("_text", "_lower")


def capability_summary(tools: DataFrame) -> DataFrame:
    """Per scan: sorted union of classes and how many tools declare any.

    There are seven classes, so the union is seven partial maxima, not a collected set.
    """
    names = sorted(name for name, _, _ in C.CAPABILITY_WORDS)
    flags = [F.coalesce(F.bool_or(F.array_contains("classes", n)), F.lit(False)).alias(n) for n in names]
    union = F.array_compact(F.array(*[F.when(F.col(f"`{n}`"), F.lit(n)) for n in names]))
    return (classify_tools(tools).groupBy("scan_id")
            .agg(*flags, F.count_if(F.size("classes") > 0).alias("tools_with_classes"))
            .select("scan_id", union.alias("classes"), "tools_with_classes"))


def capability_by_tool(tools: DataFrame) -> DataFrame:
    """The per-tool half of the summary, one row per tool that has classes.

    A filter on the classes would be pushed below the projection that finds them, and find them again.
    """
    held = F.when(F.size("classes") > 0, F.struct("pos", F.col("name").alias("tool"), "classes"))
    return unnest(classify_tools(tools), ["scan_id"], F.array(held), "t").select("scan_id", "t.*")


def declared_hits():
    """One struct per dangerous class of a tool row with ``classes``."""
    name = F.col("name")
    for i, cls in enumerate(sorted(C.DANGEROUS_CLASSES)):
        yield F.when(F.array_contains("classes", cls), finding(
            "capability.declared", F.col("pos").cast("bigint") * TOOL_STRIDE + i,
            rule_id=F.lit("capability.declared_" + cls.replace(":", "_")),
            title=(F.lit(cls),), detail=(name, F.lit(cls)), tool=name,
            meta=F.lit('{"class":"%s"}' % cls)))


def declared_findings(tools: DataFrame) -> DataFrame:
    """One info finding per tool and dangerous class."""
    return explode_findings(classify_tools(tools), *declared_hits())


def _watched(traces: DataFrame) -> DataFrame:
    """Traces that were taken: a reason for not watching silences the other checks."""
    return traces.where(F.coalesce(F.col("unobserved"), F.lit("")) == "")


def _listed(traces: DataFrame, name: str, member: str) -> tuple[Column, Column]:
    """The listed things as text and as JSON, with the number of those beyond the list, if there are any."""
    items = F.col(name)
    more = F.col(f"more_{name}") if f"more_{name}" in traces.columns else F.lit(0)
    beyond = F.when(more > 0, more)
    text = F.concat(F.array_join(items, ", "), F.when(more > 0, F.format_string(" and %d more", more)).otherwise(F.lit("")))
    return text, F.to_json(F.struct(items.alias(member), beyond.alias("more")))


def not_observed(traces: DataFrame) -> DataFrame:
    reason = F.coalesce(F.col("unobserved"), F.lit(""))
    return explode_findings(traces, F.when(
        reason != "", finding("capability.not_observed", F.lit(SERVER_SEQ), detail=(reason,))))


def observed_decoy_read(traces: DataFrame) -> DataFrame:
    """A server that read planted credentials: one finding for all paths."""
    text, meta = _listed(traces, "decoy_reads", "paths")
    return explode_findings(_watched(traces), F.when(F.size("decoy_reads") > 0, finding(
        "capability.decoy_read", F.lit(SERVER_SEQ), detail=(text,), meta=meta)))


def observed_egress(traces: DataFrame) -> DataFrame:
    """Connections attempted while the network was denied; name lookups do not count."""
    text, meta = _listed(traces, "egress_hosts", "hosts")
    return explode_findings(_watched(traces), F.when(F.col("net_denied") & (F.size("egress_hosts") > 0), finding(
        "capability.egress_unexpected", F.lit(SERVER_SEQ + 1), detail=(text,), meta=meta)))


def declared_observed_gap(traces: DataFrame, summary: DataFrame) -> DataFrame:
    """Egress seen, while no tool of the server declares net:egress."""
    declared = (summary.where(F.array_contains("classes", "net:egress"))
                .select("scan_id"))
    _, meta = _listed(traces, "egress_hosts", "hosts")
    seen = _watched(traces).where(F.col("net_denied") & (F.size("egress_hosts") > 0))
    return explode_findings(seen.join(declared, "scan_id", "left_anti"), finding(
        "capability.declared_observed_gap", F.lit(SERVER_SEQ + 2), meta=meta))
