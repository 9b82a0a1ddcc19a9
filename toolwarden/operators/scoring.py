"""From findings to scores, grades and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scales import RANKS, SEVERITY_NAMES, grade, penalty, severity_name, severity_rank
from .findings import listing_order


def dedup_rule_tool(findings: DataFrame) -> DataFrame:
    """The first finding of each (scan, rule, tool) in listing order, and how many there were.

    The first is a partial minimum, so copies of one finding collapse before the
    shuffle, however many there are.
    """
    first = F.min(F.struct(listing_order().alias("o"), F.col("severity"))).alias("first")
    return (findings.groupBy("scan_id", "rule_id", F.coalesce("tool", F.lit("")).alias("tool"))
            .agg(first, F.count("*").alias("copies"))
            .select("scan_id", "rule_id", "tool", F.col("first.severity").alias("severity"),
                    F.col("first.o").alias("listing"), "copies"))


def deductions(findings: DataFrame) -> DataFrame:
    """One row per penalty applied; order by (scan_id, points desc, listing)."""
    return (dedup_rule_tool(findings).withColumn("points", penalty(F.col("severity")))
            .where(F.col("points") > 0)
            .select("scan_id", "rule_id", "tool", "severity", "points", "listing"))


def count_by_severity(findings: DataFrame) -> DataFrame:
    """Counts of all findings per scan, before any deduplication."""
    return findings.groupBy("scan_id").agg(
        *[F.count_if(F.col("severity") == name).alias(name) for name in SEVERITY_NAMES])


def scorecards(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Score, grade, cap flag and severity counts per scan.

    Two aggregations, both with partial sums: by (scan, rule, tool), then by scan.
    ``scans`` brings in scans without findings, which score full marks.
    """
    severity = F.col("severity")
    order = listing_order()
    by_pair = findings.groupBy("scan_id", "rule_id", F.coalesce("tool", F.lit("")).alias("tool")).agg(
        F.min(F.struct(order.alias("o"), severity)).getField("severity").alias("first_severity"),
        *[F.count_if(severity == name).alias(name) for name in SEVERITY_NAMES])
    per_scan = by_pair.groupBy("scan_id").agg(
        F.sum(penalty(F.col("first_severity"))).cast("bigint").alias("points"),
        *[F.sum(name).alias(name) for name in SEVERITY_NAMES])
    if scans is not None:
        per_scan = scans.select("scan_id").join(per_scan, "scan_id", "left").na.fill(0)
    raw = F.greatest(F.lit(100) - F.col("points"), F.lit(0))
    capped = (F.col("critical") > 0) & (raw > C.CRITICAL_CAP)
    scored = (per_scan.withColumn("capped", capped)
              .withColumn("score", F.when(capped, F.lit(C.CRITICAL_CAP)).otherwise(raw).cast("int")))
    return scored.select("scan_id", "score", grade(F.col("score")).alias("grade"), "capped",
                         F.lit(C.RUBRIC_VERSION).alias("rubric_version"), *SEVERITY_NAMES)


def max_severity(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Worst severity per scan; info for scans without findings."""
    worst = findings.groupBy("scan_id").agg(F.max(severity_rank(F.col("severity"))).alias("rank"))
    if scans is not None:
        worst = scans.select("scan_id").join(worst, "scan_id", "left").na.fill(0, ["rank"])
    return worst.select("scan_id", severity_name(F.col("rank")).alias("max_severity"), "rank")


def fail_on_gate(worst: DataFrame, threshold: str = "high", errors: DataFrame | None = None) -> DataFrame:
    """One row for the run: how many scans fail the threshold, and ok / failing / error.

    ``errors`` lists targets that could not be scanned; any of them decides the run.
    """
    if threshold not in RANKS:
        raise ValueError(f"invalid severity {threshold!r} (want critical|high|medium|low|info)")
    # One aggregation over both tables; joining two totals would need a cross join.
    rows = worst.select((F.col("rank") >= RANKS[threshold]).alias("fails"), F.lit(False).alias("broken"))
    if errors is not None:
        rows = rows.unionByName(errors.select(F.lit(False).alias("fails"), F.lit(True).alias("broken")))
    verdict = (F.when(F.col("errors") > 0, F.lit("error")).when(F.col("failing") > 0, F.lit("failing"))
               .otherwise(F.lit("ok")))
    return rows.agg(F.count_if(~F.col("broken")).alias("scans"), F.count_if("fails").alias("failing"),
                    F.count_if("broken").alias("errors")).withColumn("verdict", verdict)
