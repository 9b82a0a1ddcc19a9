"""Prompt-injection patterns in tool descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import detect, regex
from ..functions.regex import matches_hinted
from .findings import TOOL_STRIDE, explode_findings, finding

_ORD = C.ANALYZER_ORDER.index("injection")


def _severity(text: str) -> str:
    return text if text in [s[0] for s in C.SEVERITIES] else "info"


def with_text(tools: DataFrame) -> DataFrame:
    """Add the searched text and its lower-case form, computed once for all patterns."""
    if "_lower" in tools.columns:
        return tools
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    whole = F.concat(blank("name"), F.lit("\n"), blank("description"))
    return tools.withColumn("_lower", regex.lowered(whole)).withColumn("_text", regex.unfolded(whole))


def with_signs(tools: DataFrame) -> DataFrame:
    """Add what the built-in detectors found: hidden text and decoded payload."""
    return (tools.withColumn("_reason", detect.invisible_reason(F.col("description")))
            .withColumn("_payload", detect.encoded_payload(F.col("description"))))


def rule_hits(rules):
    """One struct per rule: a rule fires at most once per tool."""
    null = F.lit(None).cast("string")
    for i, rule in enumerate(rules):
        hit = F.struct(
            F.lit("injection").alias("analyzer"),
            F.lit(_ORD).alias("analyzer_ord"),
            (F.col("pos").cast("bigint") * TOOL_STRIDE + i).alias("seq"),
            F.lit(rule["id"]).alias("rule_id"),
            F.lit(_severity(rule["severity"])).alias("severity"),
            F.lit(rule["title"]).alias("title"),
            F.lit(rule.get("detail") or "").alias("detail"),
            F.col("name").alias("tool"),
            F.lit(rule.get("remediation") or "").alias("remediation"),
            null.alias("meta"),
        )
        yield F.when(matches_hinted(F.col("_text"), F.col("_lower"), rule["any"]), hit)


def structural_hits(after: int = TOOL_STRIDE - 3):
    """One struct per built-in detector, listed after the rules of the same tool."""
    pos = F.col("pos").cast("bigint") * TOOL_STRIDE + after
    name, reason, payload = F.col("name"), F.col("_reason"), F.col("_payload")
    size = F.char_length("description")
    yield F.when(reason.isNotNull(),
                 finding("injection.invisible_chars", pos, tool=name, detail=(reason,)))
    yield F.when(payload.isNotNull(),
                 finding("injection.encoded_blob", pos + 1, tool=name,
                         detail=(detect.quoted(F.left(payload, F.lit(C.BLOB_QUOTE_CHARS))),)))
    yield F.when(size > C.EXCESSIVE_LENGTH,
                 finding("injection.excessive_length", pos + 2, tool=name, detail=(size,)))


def rule_findings(tools: DataFrame, rules=C.INJECTION_RULES) -> DataFrame:
    """Findings of the regex rules only."""
    if not rules:
        return structural_findings(tools).limit(0)
    return explode_findings(with_text(tools), *rule_hits(rules))


def structural_findings(tools: DataFrame) -> DataFrame:
    """Findings of the built-in detectors: hidden text, payloads, length."""
    return explode_findings(with_signs(tools), *structural_hits())


def injection_findings(tools: DataFrame, rules=C.INJECTION_RULES) -> DataFrame:
    """All injection findings in one pass over the tools.

    ``rules`` replaces the default regex rules; the detectors always run.
    """
    return explode_findings(with_signs(with_text(tools)), *rule_hits(rules), *structural_hits())
