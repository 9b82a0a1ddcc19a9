"""The registry index: latest scans, statistics, leaderboards, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..sources.documents import fixed, write_document

GRADES = [letter for letter, _ in C.GRADE_FLOORS] + [C.LOWEST_GRADE]
SUMMARY_COLUMNS = ("id", "source", "identifier", "canonical_url", "registry", "version", "grade", "score",
                   "manifest_hash", "tool_count", "token_estimate", "critical", "high", "scanned_at")


def upsert_servers(servers: DataFrame, seen: DataFrame) -> DataFrame:
    """Server table after a batch of scans.

    ``seen`` has (source, identifier, canonical_url, registry, seen_at).  Registry and
    first_seen stay as first written; a non-NULL canonical_url replaces the old one.
    One aggregation over old and new rows, all partial minima and maxima.
    """
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    old = servers.select("source", "identifier", "canonical_url", "registry", "first_seen", "last_seen",
                         F.lit(0).alias("age"))
    new = seen.select("source", "identifier", blank("canonical_url").alias("canonical_url"),
                      blank("registry").alias("registry"), F.col("seen_at").alias("first_seen"),
                      F.col("seen_at").alias("last_seen"), F.lit(1).alias("age"))
    first = F.struct("age", "first_seen")
    url_order = F.when(F.col("canonical_url").isNotNull(), F.struct("age", "last_seen", "canonical_url"))
    return (old.unionByName(new).groupBy("source", "identifier").agg(
        F.max_by("canonical_url", url_order).alias("canonical_url"),
        F.min(F.struct(first.alias("o"), "registry")).getField("registry").alias("registry"),
        F.min(first).getField("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"))
        .withColumn("id", server_id(F.col("source"), F.col("identifier"))))


def server_id(source: Column, identifier: Column) -> Column:
    """Identity of a server: a hash of its natural key, equal in every run."""
    return F.xxhash64(source, identifier)


def latest_scan(scans: DataFrame) -> DataFrame:
    """Newest scan of each server by (scanned_at, id).

    A partial maximum per server: a server with very many scans is never sorted.
    """
    rest = [c for c in scans.columns if c != "server_id"]
    newest = F.max_by(F.struct(*rest), F.struct("scanned_at", "id"))
    return scans.groupBy("server_id").agg(newest.alias("s")).select("server_id", "s.*")


def finding_counts(findings: DataFrame, scan_ids: DataFrame) -> DataFrame:
    """Findings by severity for the given scans, one column per severity."""
    wanted = scan_ids.select("scan_id")
    return (findings.join(wanted, "scan_id", "left_semi").groupBy("scan_id")
            .agg(*[F.count_if(F.col("severity") == s).alias(s) for s, _, _ in C.SEVERITIES]))


def tool_counts(tool_defs: DataFrame, scan_ids: DataFrame) -> DataFrame:
    """Tools and their representative tokens for the given scans."""
    wanted = scan_ids.select("scan_id")
    return (tool_defs.join(wanted, "scan_id", "left_semi").groupBy("scan_id")
            .agg(F.count("*").alias("tool_count"), F.coalesce(F.sum(_representative()), F.lit(0)).alias("token_estimate")))


def _representative() -> Column:
    return F.get_json_object("token_count_by_model_json", "$.representative").cast("bigint")


def _scan_totals(findings: DataFrame, tool_defs: DataFrame) -> DataFrame:
    """The headline numbers of every scan: one aggregation of whole numbers over both tables.

    It sums where rows are read, so totals of scans are all that moves, and a task that joins
    them holds one table of sums and one sorted run of each side, whatever the number of tables.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    flag = lambda s: F.when(F.col("severity") == s, one).otherwise(zero).alias(s)
    rows = findings.select("scan_id", flag("critical"), flag("high"), zero.alias("tool_count"), zero.alias("token_estimate")).unionByName(
        tool_defs.select("scan_id", zero.alias("critical"), zero.alias("high"), one.alias("tool_count"),
                         F.coalesce(_representative(), zero).alias("token_estimate")))
    return rows.groupBy("scan_id").agg(*[F.sum(c).alias(c) for c in rows.columns[1:]])


def list_latest(servers: DataFrame, scans: DataFrame, findings: DataFrame, tool_defs: DataFrame) -> DataFrame:
    """Every server with its latest scan and that scan's headline numbers.

    Findings and tools are summed by scan as they are read; the one join with these sums
    leaves those of the latest scans.
    """
    latest = latest_scan(scans.select("server_id", "id", "scanned_at", "version", "grade", "score",
                                      "manifest_hash")).withColumnRenamed("id", "scan_id")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return (servers.join(latest, servers["id"] == latest["server_id"])
            .join(_scan_totals(findings, tool_defs), "scan_id", "left")
            .select("id", "source", "identifier", blank("canonical_url"), blank("registry"), blank("version"),
                    "grade", "score", "manifest_hash", zero("tool_count"), zero("token_estimate"),
                    zero("critical"), zero("high"), "scanned_at"))


def stats(summary: DataFrame, drift_events: DataFrame, as_of: Column) -> DataFrame:
    """One row: servers, servers per grade, servers with a critical finding, recent events."""
    now = as_of.cast("timestamp")
    recent = drift_events.where(F.col("detected_at") > now - F.expr(f"INTERVAL {C.STATS_WINDOW_DAYS} DAYS"))
    # One aggregation over servers and events; joining two totals would need a cross join.
    rows = summary.select("grade", (F.col("critical") > 0).alias("bad"), F.lit(True).alias("server")).unionByName(
        recent.select(F.lit(None).cast("string").alias("grade"), F.lit(False).alias("bad"), F.lit(False).alias("server")))
    return rows.agg(
        F.count_if("server").alias("total_servers"),
        *[F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in GRADES],
        F.count_if("bad").alias("servers_with_critical"), F.count_if(~F.col("server")).alias("drift_events_30d"))


def recent_drift(drift_events: DataFrame, servers: DataFrame, limit: int = C.DRIFT_FEED_ROWS) -> DataFrame:
    """Newest events of known servers with the server's identifier; equal times by event id."""
    known = servers.select(F.col("id").alias("server_id"), F.col("identifier").alias("server_identifier"))
    if "target" not in drift_events.columns:
        drift_events = drift_events.withColumn("target", F.get_json_object("diff_json", "$.target"))
    return (drift_events.select("id", "server_id", "kind", "severity",
                                F.coalesce("target", F.lit("")).alias("target"), "detected_at")
            .join(known, "server_id")
            .orderBy(F.desc("detected_at"), F.desc("id")).limit(limit)
            .select("id", "server_identifier", "kind", "severity", "target", "detected_at"))


def worst_first(summary: DataFrame) -> DataFrame:
    """Servers by score, lowest first; equal scores by server id."""
    return summary.orderBy("score", "id")


def cost_leaderboard(summary: DataFrame, rows: int = C.LEADERBOARD_ROWS) -> DataFrame:
    """The most expensive servers; ties keep the worst-first order."""
    return summary.orderBy(F.desc("token_estimate"), "score", "id").limit(rows)


def snapshot(summary: DataFrame, stats_row: DataFrame, drift_rows: DataFrame, generated_at: Column,
             tool_version: str) -> DataFrame:
    """The published snapshot as rows of (section, ord_a, ord_b, body).

    Header, statistics, leaderboard and drift feed are small by definition.  Servers
    are not: they stay one row each, ordered by (score, id), so no task ever holds the
    registry.
    """
    def part(df: DataFrame, section: str, a: Column, b: Column, cols) -> DataFrame:
        return df.select(F.lit(section).alias("section"), a.cast("bigint").alias("ord_a"),
                         b.cast("bigint").alias("ord_b"), F.to_json(F.struct(*cols)).alias("body"))

    zero = F.lit(0)
    head = part(stats_row.select(F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"),
                                 F.lit(tool_version).alias("tool_version"),
                                 F.lit(C.RUBRIC_VERSION).alias("rubric_version")),
                "header", zero, zero, ("generated_at", "tool_version", "rubric_version"))
    totals = part(stats_row, "stats", zero, zero, stats_row.columns)
    servers = part(summary, "servers", F.col("score"), F.col("id"), SUMMARY_COLUMNS)
    board = part(cost_leaderboard(summary), "context_cost_leaderboard", -F.col("token_estimate"),
                 F.col("score") * 0 + F.col("id"), SUMMARY_COLUMNS)
    feed = part(drift_rows, "recent_drift", -F.unix_micros("detected_at"), -F.col("id"),
                ("server_identifier", "kind", "severity", "target", "detected_at"))
    return head.unionByName(totals).unionByName(servers).unionByName(board).unionByName(feed)


def snapshot_document(rows: DataFrame, path: str) -> None:
    """The published snapshot as one JSON object, from the rows of ``snapshot``."""
    sections = ["header", "stats", "servers", "context_cost_leaderboard", "recent_drift"]
    place = F.array_position(F.array(*[F.lit(x) for x in sections]), F.col("section")) * 2
    body = F.col("body")
    inner = F.substring(body, F.lit(2), F.length(body) - 2)
    # Grades are columns of the statistics and members of one object in the document.
    total = lambda c: F.get_json_object(body, f"$.{c}").cast("bigint").alias(c)
    grades = F.struct(*[total(f"grade_{g.lower()}").alias(g) for g in GRADES])
    statistics = F.to_json(F.struct(total("total_servers"), grades.alias("grade_distribution"), total("servers_with_critical"),
                                    total("drift_events_30d")))
    text = F.when(F.col("section") == "header", inner).when(F.col("section") == "stats", statistics).otherwise(body)
    listed = ~F.col("section").isin("header", "stats")
    pieces = rows.select(place.cast("int").alias("place"), "ord_a", "ord_b", text.alias("text"), listed.alias("starts"), listed.alias("ends"))
    between = fixed(rows.sparkSession, {1: "{", 3: ',"stats":', 5: ',"servers":[', 7: '],"context_cost_leaderboard":[',
                                        9: '],"recent_drift":[', 11: "]}"})
    zero = F.lit(0).cast("bigint")
    write_document(pieces.unionByName(between.select("place", zero.alias("ord_a"), zero.alias("ord_b"), "text", "starts", "ends")),
                   path, ["place", "ord_a", "ord_b"])


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """How many targets were scanned and how many failed; ``outcomes`` has ``error`` per target."""
    return outcomes.agg(F.count_if(F.col("error").isNull()).alias("scanned"),
                        F.count_if(F.col("error").isNotNull()).alias("failed"))
