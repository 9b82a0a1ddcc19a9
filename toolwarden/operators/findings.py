"""The findings table every analyzer writes and how its rows are ordered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.rows import unnest

FINDINGS_SCHEMA = (
    "scan_id bigint, analyzer string, analyzer_ord int, seq bigint, rule_id string, "
    "severity string, title string, detail string, tool string, remediation string, meta string"
)
COLUMNS = [part.split()[0] for part in FINDINGS_SCHEMA.split(", ")]

#: Room for the findings of one tool between two tool positions in ``seq``.
TOOL_STRIDE = 10_000
#: Findings about the whole server come after those about its tools.
SERVER_SEQ = 1 << 50


def fill(template: str | None, *values: Column) -> Column:
    """A fixed text with ``{}`` replaced by column values, in order."""
    if template is None:
        return F.lit(None).cast("string")
    pieces = template.split("{}")
    if len(pieces) == 1:
        return F.lit(template)
    parts: list[Column] = []
    for i, piece in enumerate(pieces):
        if piece:
            parts.append(F.lit(piece))
        if i < len(values):
            parts.append(values[i].cast("string"))
    return F.concat(*parts)


def finding(rule: str, seq: Column, *, rule_id: Column | None = None, severity: Column | None = None,
            title: tuple = (), detail: tuple | Column = (), tool: Column | None = None,
            remediation: tuple = (), meta: Column | None = None) -> Column:
    """One finding as a struct, with its texts taken from the fixed table."""
    fixed_severity, fixed_title, fixed_detail, fixed_fix = C.TEXTS[rule]
    analyzer = rule.split(".")[0]
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit(analyzer).alias("analyzer"),
        F.lit(C.ANALYZER_ORDER.index(analyzer)).alias("analyzer_ord"),
        seq.cast("bigint").alias("seq"),
        (F.lit(rule) if rule_id is None else rule_id).alias("rule_id"),
        (F.lit(fixed_severity) if severity is None else severity).alias("severity"),
        fill(fixed_title, *title).alias("title"),
        (detail if isinstance(detail, Column) else fill(fixed_detail, *detail)).alias("detail"),
        (null if tool is None else tool).alias("tool"),
        fill(fixed_fix, *remediation).alias("remediation"),
        (null if meta is None else meta).alias("meta"),
    )


def explode_findings(df: DataFrame, *hits: Column) -> DataFrame:
    """Rows of the findings table for the non-NULL structs among ``hits``."""
    return rows_of(df, F.array(*hits))


def rows_of(df: DataFrame, hits: Column) -> DataFrame:
    """One row per non-NULL struct of an array of findings."""
    return unnest(df, ["scan_id"], hits, "f").select("scan_id", "f.*")


def findings_union(*parts: DataFrame) -> DataFrame:
    """All analyzers' findings as one table; ``analyzer_ord``, ``seq`` keep the listing order."""
    return reduce(DataFrame.unionByName, parts)


def listing_order() -> Column:
    """Sort key of a finding inside its scan."""
    return F.struct("analyzer_ord", "seq", F.coalesce("tool", F.lit("")).alias("t"), "title")
