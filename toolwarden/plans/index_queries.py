"""Queries over findings and the index: scores, gates, reports, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scales import SEVERITY_NAMES
from ..operators import cost, index, injection, manifest, report, scoring
from ..session import stored
from ..sources import captures, documents, store, traces
from . import bridge as B
from . import checks as K
from . import recording
from .analysis_queries import OVERSIZED_DOCUMENTS
from .drift_queries import HISTORY, versions_of
from .registry import CHECKS, query
from .scan import ScanInputs, scan_findings, scan_scorecards, tool_facts

# --- scoring -------------------------------------------------------------------

_FIRST = f"WITH findings AS ({K.FINDINGS}), firsts AS ({K.FIRST})"
_SEVERITY_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITY_NAMES)
_SCORES = f"""{_FIRST}, scans AS ({K.SCANS}),
  points AS (SELECT scan_id, sum(points) AS points FROM firsts WHERE nth = 1 GROUP BY 1),
  counts AS (SELECT scan_id, {_SEVERITY_COUNTS} FROM findings GROUP BY 1),
  raw AS (SELECT s.scan_id, greatest(100 - coalesce(points, 0), 0) AS raw, {', '.join(
      f'coalesce({s}, 0) AS {s}' for s in SEVERITY_NAMES)}
    FROM scans s LEFT JOIN points p ON p.scan_id = s.scan_id LEFT JOIN counts c ON c.scan_id = s.scan_id),
  scored AS (SELECT *, critical > 0 AND raw > 39 AS capped,
    CAST(CASE WHEN critical > 0 AND raw > 39 THEN 39 ELSE raw END AS BIGINT) AS score FROM raw),
  cards AS (SELECT scan_id, score, {K.GRADE_CASE} AS grade, capped, CAST(1 AS BIGINT) AS rubric_version,
    {', '.join(SEVERITY_NAMES)} FROM scored)"""


def _cards(spark, sf):
    return scoring.scorecards(B.findings(spark, sf), B.clean_scans(spark, sf))


#: The checks of all analyzers that ``findings_union`` runs over the given tables.
_ANALYZERS = (
    "rule_findings", "invisible_chars", "encoded_blob", "excessive_length", "declared_findings", "schema_bloat",
    "observed_decoy_read", "observed_egress", "declared_observed_gap", "not_observed", "typosquat", "metadata_unavailable",
    "install_script", "no_source", "single_maintainer", "young_package", "known_cve", "unauthenticated_listing",
    "plaintext_http", "weak_tls", "drift_findings",
)
_FOUND = ", ".join(K.FINDING_COLUMNS)


@query("findings_union", " UNION ALL ".join(
    f"SELECT {_FOUND} FROM ({sql})" for sql in (*[CHECKS[name] for name in _ANALYZERS], OVERSIZED_DOCUMENTS)))
def findings_union(spark, sf):
    """The findings of all six analyzers, each over its own tables, in one scan."""
    base, cur = versions_of(spark, sf)
    inputs = ScanInputs(
        B.tools(spark, sf), specs=B.package_specs(spark, sf), packages=B.packages(spark, sf), advisories=B.advisory_rows(spark, sf),
        endpoints=B.endpoints(spark, sf), traces=traces.trace_behavior(B.trace_lines(spark, sf), B.trace_runs(spark, sf)),
        baseline=base, current=cur, as_of=F.lit(K.AS_OF).cast("timestamp"))
    return scan_findings(inputs).select(*K.FINDING_COLUMNS)


@query("dedup_rule_tool", _FIRST + """ SELECT scan_id, rule_id, tool, max(severity) FILTER (nth = 1) AS severity,
  count(*) AS copies FROM firsts GROUP BY 1, 2, 3""")
def dedup_rule_tool(spark, sf):
    return scoring.dedup_rule_tool(B.findings(spark, sf)).drop("listing")


@query("deductions", _FIRST + """ SELECT scan_id, rule_id, tool, severity, CAST(points AS BIGINT) AS points
  FROM firsts WHERE nth = 1 AND points > 0""")
def deductions(spark, sf):
    return scoring.deductions(B.findings(spark, sf)).orderBy("scan_id", F.desc("points"), "listing").drop("listing")


@query("count_by_severity", f"WITH findings AS ({K.FINDINGS}) SELECT scan_id, {_SEVERITY_COUNTS} FROM findings GROUP BY 1")
def count_by_severity(spark, sf):
    return scoring.count_by_severity(B.findings(spark, sf))


@query("score", _SCORES + " SELECT * FROM cards")
def score(spark, sf):
    return _cards(spark, sf)


@query("grade", _SCORES + " SELECT grade, count(*) AS scans FROM cards GROUP BY 1")
def grade(spark, sf):
    return _cards(spark, sf).groupBy("grade").agg(F.count("*").alias("scans"))


_WORST = f"""{_SCORES}, worst AS (SELECT scan_id, CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high'
  WHEN medium > 0 THEN 'medium' WHEN low > 0 THEN 'low' ELSE 'info' END AS max_severity FROM raw)"""


@query("max_severity", _WORST + " SELECT scan_id, max_severity FROM worst")
def max_severity(spark, sf):
    return scoring.max_severity(B.findings(spark, sf), B.clean_scans(spark, sf)).select("scan_id", "max_severity")


@query("fail_on_gate", _WORST + """ SELECT count(*) AS scans,
  count(*) FILTER (max_severity IN ('critical', 'high')) AS failing, CAST(0 AS BIGINT) AS errors,
  CASE WHEN count(*) FILTER (max_severity IN ('critical', 'high')) > 0 THEN 'failing' ELSE 'ok' END AS verdict
  FROM worst""")
def fail_on_gate(spark, sf):
    return scoring.fail_on_gate(scoring.max_severity(B.findings(spark, sf), B.clean_scans(spark, sf)), "high")


# --- the whole scan --------------------------------------------------------------

def _scan_sql() -> str:
    """Per-tool rules as (scan, rule, tool, severity) pairs, scored."""
    parts = [f"SELECT scan_id, '{r['id']}' AS rule_id, name AS tool, '{r['severity']}' AS severity FROM tools "
             f"WHERE {K.rule_match(r, 'name || chr(10) || description')}" for r in C.INJECTION_RULES]
    parts += [
        "SELECT scan_id, 'context.schema_bloat', name, 'low' FROM tools WHERE depth > 5",
        "SELECT scan_id, 'injection.excessive_length', name, 'low' FROM tools WHERE length(description) > 1500",
        r"SELECT scan_id, 'injection.invisible_chars', name, 'high' FROM tools WHERE regexp_matches(description, "
        r"'[\x{200b}-\x{200d}\x{feff}\x{202a}-\x{202e}\x{2066}-\x{2069}]') OR len(list_filter("
        r"regexp_extract_all(description, '\p{L}+'), lambda w: regexp_matches(w, '\p{Latin}') AND "
        r"regexp_matches(w, '[\p{Cyrillic}\p{Greek}]'))) > 0",
        "SELECT scan_id, 'injection.encoded_blob', name, 'medium' FROM tools WHERE doc_id % 12 = 5",
        "SELECT page_id, 'authposture.unauthenticated_listing', '', 'high' FROM pages WHERE page_id % 3 = 0",
        "SELECT page_id, 'authposture.plaintext_http', '', 'high' FROM pages WHERE url NOT LIKE 'https://%'",
        "SELECT page_id, 'authposture.weak_tls', '', 'medium' FROM pages WHERE url LIKE 'https://%' "
        "AND page_id % 7 <> 0 AND 768 + page_id % 5 < 771",
    ]
    return f"""WITH tools AS ({K.TOOLS}), hits AS ({' UNION ALL '.join(parts)}),
  points AS (SELECT scan_id, sum(penalty) AS points, bool_or(severity = 'critical') AS critical FROM
    (SELECT DISTINCT * FROM hits) JOIN (VALUES {K.SEVERITY_ROWS}) s(name, rank, penalty) ON s.name = severity GROUP BY 1),
  scans AS (SELECT scan_id FROM tools UNION SELECT page_id FROM pages),
  raw AS (SELECT s.scan_id, greatest(100 - coalesce(points, 0), 0) AS raw, coalesce(critical, false) AS critical
    FROM scans s LEFT JOIN points p ON p.scan_id = s.scan_id),
  scored AS (SELECT scan_id, CAST(CASE WHEN critical AND raw > 39 THEN 39 ELSE raw END AS BIGINT) AS score,
    critical AND raw > 39 AS capped FROM raw)
  SELECT scan_id, score, {K.GRADE_CASE} AS grade, capped FROM scored"""


@query("scorecard_per_scan", _scan_sql())
def scorecard_per_scan(spark, sf):
    """Documents as tools, all text analyzers and endpoint checks, scored per scan."""
    inputs = ScanInputs(B.tools(spark, sf), endpoints=B.endpoints(spark, sf))
    return scan_scorecards(inputs).select("scan_id", "score", "grade", "capped")


# --- index ----------------------------------------------------------------------

def _as_of():
    return F.lit("2024-02-10 00:00:00").cast("timestamp")


def _summary(spark, sf):
    return index.list_latest(B.index_servers(spark, sf), B.index_scans(spark, sf), B.index_findings(spark, sf),
                             B.index_tools(spark, sf))


@query("upsert_servers", """
  WITH seen AS (SELECT CASE user_id % 2 WHEN 0 THEN 'npm' ELSE 'http' END AS source, 'u' || user_id AS identifier,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'https://' || event_type END AS url, event_id, ts FROM events),
  grouped AS (SELECT source, identifier, arg_max(url, (ts, url)) FILTER (url IS NOT NULL) AS new_url,
    min(ts) AS first_ts, max(ts) AS last_ts,
    (list(CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'official' END ORDER BY ts))[1] AS new_registry
    FROM seen GROUP BY 1, 2),
  old AS (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0)
  SELECT source, identifier, coalesce(new_url, CASE WHEN user_id IS NULL THEN NULL ELSE 'https://old' END) AS canonical_url,
    CASE WHEN user_id IS NULL THEN new_registry ELSE 'first' END AS registry,
    epoch_us(CASE WHEN user_id IS NULL THEN first_ts ELSE TIMESTAMP '2023-01-01' END) AS first_seen,
    epoch_us(last_ts) AS last_seen
  FROM grouped LEFT JOIN old ON 'u' || user_id = identifier""")
def upsert_servers(spark, sf):
    events = B.table(spark, sf, "events")
    source = "CASE user_id % 2 WHEN 0 THEN 'npm' ELSE 'http' END AS source"
    seen = events.selectExpr(source, "concat('u', user_id) AS identifier",
                             "CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('https://', event_type) END AS canonical_url",
                             "CASE WHEN event_id % 4 = 0 THEN '' ELSE 'official' END AS registry", "ts AS seen_at")
    # A third of the servers was already known.
    known = events.where("user_id % 3 = 0").selectExpr(
        source, "concat('u', user_id) AS identifier", "'https://old' AS canonical_url", "'first' AS registry",
        "timestamp '2023-01-01' AS first_seen", "timestamp '2023-06-01' AS last_seen").distinct()
    return index.upsert_servers(known, seen).drop("id")


@query("latest_scan", f"WITH {K.LATEST} SELECT server_id, scan_id AS id, epoch_us(scanned_at) AS scanned_at, score, grade FROM latest")
def latest_scan(spark, sf):
    return index.latest_scan(B.index_scans(spark, sf)).select("server_id", "id", "scanned_at", "score", "grade")


@query("finding_counts", f"WITH {K.LATEST} SELECT * FROM counts")
def finding_counts(spark, sf):
    ids = index.latest_scan(B.index_scans(spark, sf)).select(F.col("id").alias("scan_id"))
    return index.finding_counts(B.index_findings(spark, sf), ids)


@query("tool_counts", f"WITH {K.LATEST} SELECT * FROM tool_totals")
def tool_counts(spark, sf):
    ids = index.latest_scan(B.index_scans(spark, sf)).select(F.col("id").alias("scan_id"))
    return index.tool_counts(B.index_tools(spark, sf), ids)


@query("list_latest", f"WITH {K.LATEST} SELECT * FROM summary")
def list_latest(spark, sf):
    return _summary(spark, sf)


_GRADE_COUNTS = ", ".join(f"count(*) FILTER (grade = '{g}') AS grade_{g.lower()}" for g in index.GRADES)


@query("stats", f"""WITH {K.LATEST}, {K.DRIFT_ROWS} SELECT count(*) AS total_servers, {_GRADE_COUNTS},
  count(*) FILTER (critical > 0) AS servers_with_critical,
  (SELECT count(*) FROM drift WHERE detected_at > TIMESTAMP '2024-02-10' - INTERVAL 30 DAYS) AS drift_events_30d
  FROM summary""")
def stats(spark, sf):
    return index.stats(_summary(spark, sf), B.index_events(spark, sf), _as_of())


_RECENT = """SELECT d.id, identifier AS server_identifier, kind, severity, target, epoch_us(detected_at) AS detected_at
  FROM drift d JOIN servers s ON s.id = d.server_id ORDER BY d.detected_at DESC, d.id DESC LIMIT 50"""


@query("recent_drift", f"WITH {K.LATEST}, {K.DRIFT_ROWS} {_RECENT}")
def recent_drift(spark, sf):
    return index.recent_drift(B.index_events(spark, sf), B.index_servers(spark, sf))


@query("worst_first", f"WITH {K.LATEST} SELECT id, identifier, score, grade FROM summary ORDER BY score, id")
def worst_first(spark, sf):
    return index.worst_first(_summary(spark, sf)).select("id", "identifier", "score", "grade")


@query("cost_leaderboard", f"""WITH {K.LATEST} SELECT id, identifier, token_estimate, score FROM summary
  ORDER BY token_estimate DESC, score, id LIMIT 20""")
def cost_leaderboard(spark, sf):
    return index.cost_leaderboard(_summary(spark, sf)).select("id", "identifier", "token_estimate", "score")


@query("snapshot", f"""WITH {K.LATEST}, {K.DRIFT_ROWS}, feed AS ({_RECENT}),
  board AS (SELECT * FROM summary ORDER BY token_estimate DESC, score, id LIMIT 20)
  SELECT 'header' AS section, CAST(0 AS BIGINT) AS ord_a, '2024-02-10T00:00:00Z' AS name, CAST(1 AS BIGINT) AS value
  UNION ALL SELECT 'stats', 0, '', (SELECT count(*) FROM summary)
  UNION ALL SELECT 'servers', score, identifier, token_estimate FROM summary
  UNION ALL SELECT 'context_cost_leaderboard', -token_estimate, identifier, token_estimate FROM board
  UNION ALL SELECT 'recent_drift', -detected_at, server_identifier, NULL FROM feed""")
def snapshot(spark, sf):
    summary = stored(_summary(spark, sf), "summary")
    servers, events = B.index_servers(spark, sf), B.index_events(spark, sf)
    rows = index.snapshot(summary, index.stats(summary, events, _as_of()), index.recent_drift(events, servers),
                          _as_of(), "0.1.0")
    item = lambda key: F.get_json_object("body", f"$.{key}")
    name = F.coalesce(item("generated_at"), item("identifier"), item("server_identifier"), F.lit(""))
    value = F.coalesce(item("rubric_version"), item("total_servers"), item("token_estimate")).cast("bigint")
    return rows.select("section", "ord_a", name.alias("name"), value.alias("value"))


@query("batch_summary", """SELECT count(*) FILTER (p_partkey % 6 <> 4) AS scanned,
  count(*) FILTER (p_partkey % 6 = 4) AS failed FROM part""")
def batch_summary(spark, sf):
    from ..sources import discovery
    return index.batch_summary(discovery.work_items(B.discovered(spark, sf)))


_HISTORY_TOOLS = """
  SELECT scan_id, pos, name, description, doc_id FROM (
    SELECT doc_id AS scan_id, 0 AS pos, 'shared' AS name, nfc_normalize(text || {phrase}) AS description, doc_id FROM documents
    UNION ALL SELECT doc_id, 1, lang, lang, doc_id FROM documents)""".format(phrase=B.PHRASE_CASE)


def _record_sql() -> str:
    hits = " UNION ALL ".join(f"SELECT scan_id, '{r['id']}' AS rule_id, '{r['severity']}' AS severity FROM tools "
                              f"WHERE {K.rule_match(r, 'name || chr(10) || description')}" for r in C.INJECTION_RULES)
    count = "count(*) AS row_count, CAST(sum({}) AS BIGINT) AS checksum"
    return HISTORY.replace("tools AS (", "both_tools AS (").replace("JOIN tools t", "JOIN both_tools t") + f""",
  tools AS ({_HISTORY_TOOLS}), hits AS ({hits}),
  points AS (SELECT scan_id, sum(penalty) AS points, bool_or(severity = 'critical') AS critical
    FROM hits JOIN (VALUES {K.SEVERITY_ROWS}) s(name, rank, penalty) ON s.name = severity GROUP BY 1),
  scored AS (SELECT id, CASE WHEN critical AND points < 61 THEN 39 ELSE greatest(100 - coalesce(points, 0), 0) END AS score
    FROM scans LEFT JOIN points ON scan_id = id)
  SELECT 'servers' AS stored, {count.format("epoch(seen)")} FROM (SELECT max(seen) AS seen FROM scans GROUP BY source)
  UNION ALL SELECT 'scans', {count.format("score + id")} FROM scored
  UNION ALL SELECT 'findings', {count.format("scan_id")} FROM hits
  UNION ALL SELECT 'tool_defs', {count.format("scan_id")} FROM tools
  UNION ALL SELECT 'drift ' || kind, {count.format("p.id + p.prev")} FROM changes c JOIN pairs p ON p.id = c.id GROUP BY kind"""


@query("record_scans", _record_sql())
def record_scans(spark, sf):
    """Captures of each source scanned and recorded in two batches, the second one twice; the store read back."""
    from ..session import shared_dir
    from ..sources import files
    path, folder = shared_dir(spark, "store"), shared_dir(spark, "staged")
    history = B.capture_history(spark, sf)
    ids = captures.captured(captures.ingest_manifests(history, canonical=False)).select("scan_id")
    middle = ids.agg(F.expr("percentile_approx(scan_id, 0.5, 10000)").alias("m")).first()["m"]
    # One batch of texts is staged at a time.
    for batch, mine, times in (("b1", F.col("scan_id") <= middle, 1), ("b2", F.col("scan_id") > middle, 2)):
        hashed = manifest.manifest_hash(captures.captured(captures.ingest_manifests(history.where(mine))))
        part = recording.written(spark, f"{folder}/{batch}", hashed.select(
            "scan_id", "source", "identifier", "scanned_at", "server_version", "tools", "canonical", "manifest_hash"))
        tools = captures.tools_table(part)
        found = recording.written(spark, f"{folder}/findings-{batch}", injection.rule_findings(tools))
        cards = scoring.scorecards(found, part).select("scan_id", "score", "grade")
        scans = part.join(cards, "scan_id").select(
            "scan_id", "source", "identifier", F.lit("").alias("canonical_url"), F.lit("official").alias("registry"),
            F.col("server_version").alias("version"), "scanned_at", "score", "grade", "manifest_hash",
            F.col("canonical").alias("manifest_json"))
        for _ in range(times):
            recording.record_scans(spark, path, batch, recording.Reports(scans, found, cost.tool_tokens(tools), "0.1.0"))
        files.remove(spark, folder)
    get = lambda name: store.read_table(spark, path, name)
    counted = lambda rows, name, key: rows.agg(
        F.lit(name).alias("stored"), F.count("*").alias("row_count"), F.sum(key).cast("bigint").alias("checksum"))
    kinds = get("drift_events").groupBy(F.concat(F.lit("drift "), "kind").alias("stored")).agg(
        F.count("*").alias("row_count"), F.sum(F.col("to_scan_id") + F.col("from_scan_id")).alias("checksum"))
    return (counted(store.read_servers(spark, path), "servers", F.unix_timestamp("last_seen"))
            .unionByName(counted(get("scans"), "scans", F.col("score") + F.col("id")))
            .unionByName(counted(get("findings"), "findings", F.col("scan_id")))
            .unionByName(counted(get("tool_defs"), "tool_defs", F.col("scan_id"))).unionByName(kinds))


# --- reports ----------------------------------------------------------------------

_LEVEL = "CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"


def _targets(spark, sf):
    return B.clean_scans(spark, sf).select("scan_id", F.when(
        F.col("scan_id") % 10 != 0, F.concat(F.lit("srv-"), F.col("scan_id"))).alias("target"))


@query("sarif_results", f"""WITH findings AS ({K.FINDINGS}), t AS (SELECT *,
  CASE WHEN scan_id % 10 <> 0 THEN 'srv-' || scan_id ELSE '' END AS target FROM findings)
  SELECT scan_id, seq, rule_id, {_LEVEL} AS level,
    title || CASE WHEN detail <> '' THEN '. ' || detail ELSE '' END || coalesce(' Fix: ' || remediation, '') AS message,
    CASE WHEN target <> '' THEN 'mcp-server/' || target ELSE 'mcp-server' END AS uri,
    target || coalesce('/' || tool, '') AS logical_name FROM t""")
def sarif_results(spark, sf):
    return report.sarif_results(B.findings(spark, sf), _targets(spark, sf)).drop("analyzer_ord")


@query("sarif_rules", f"""WITH findings AS ({K.FINDINGS}), o AS (SELECT *, row_number() OVER (PARTITION BY rule_id
    ORDER BY scan_id, analyzer_ord, seq, coalesce(tool, ''), title) AS nth FROM findings)
  SELECT rule_id, title, {_LEVEL} AS level FROM o WHERE nth = 1""")
def sarif_rules(spark, sf):
    return report.sarif_rules(B.findings(spark, sf))


@query("findings_table", f"""WITH findings AS ({K.FINDINGS})
  SELECT scan_id, severity, rule_id, title, tool, CAST(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3
    WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS BIGINT) AS severity_rank
  FROM findings ORDER BY scan_id, severity_rank DESC, analyzer_ord, seq""")
def findings_table(spark, sf):
    return report.findings_table(B.findings(spark, sf)).select(
        "scan_id", "severity", "rule_id", "title", "tool", "severity_rank")


@query("grade_notes", _SCORES + """ SELECT scan_id, score, grade,
  CASE WHEN capped THEN ', capped by a critical finding' ELSE '' END AS note FROM cards""")
def grade_notes(spark, sf):
    return report.grade_notes(B.findings(spark, sf), _cards(spark, sf))


def _reports(spark, sf):
    return report.report_pieces(_targets(spark, sf), _cards(spark, sf), B.findings(spark, sf))


@query("report_json", f"""{_SCORES} SELECT c.scan_id, score, grade, CAST(critical + high + medium + low + info AS BIGINT) AS findings
  FROM cards c""")
def report_json(spark, sf):
    """The reports of all scans as pieces: findings are pieces of their own, the score is one."""
    pieces = _reports(spark, sf)
    scored = F.when(F.col("place") == 6, F.concat(F.lit("{"), F.regexp_extract("text", r'^\],"score":\{(.*),"deductions":\[$', 1), F.lit("}")))
    item = lambda key: F.get_json_object("scored", f"$.{key}")
    return pieces.withColumn("scored", scored).groupBy("scan_id").agg(
        F.max(item("score")).cast("bigint").alias("score"), F.max(item("grade")).alias("grade"),
        F.count_if(F.col("place") == 5).alias("findings"))


_JSON_LINE = "struct<name:string,rule_id:string,severity:string,title:string,tool:string,points:int,identifier:string,token_estimate:bigint>"


@query("report_document", f"""WITH findings AS ({K.FINDINGS}), scans AS ({K.SCANS})
  SELECT 'finding' AS part, rule_id, severity, title, coalesce(tool, '') AS tool, count(*) AS n FROM findings GROUP BY ALL
  UNION ALL SELECT 'report', '', '', '', '', count(*) FROM scans""")
def report_document(spark, sf):
    """All reports as one JSON file, read back in splits."""
    from ..session import shared_dir
    path = shared_dir(spark, "reports") + ".json"
    report.write_reports(_reports(spark, sf), path)
    lines = documents.read_lines(spark, path)
    item = F.from_json("text", _JSON_LINE)
    found = lines.where(F.col("text").startswith('{"analyzer"')).select(item.alias("f")).select(
        F.lit("finding").alias("part"), "f.rule_id", "f.severity", "f.title", F.coalesce("f.tool", F.lit("")).alias("tool"))
    opened = lines.where(F.col("text").startswith('{"scan_id"')).select(F.lit("report").alias("part"), *[
        F.lit("").alias(c) for c in ("rule_id", "severity", "title", "tool")])
    return found.unionByName(opened).groupBy("part", "rule_id", "severity", "title", "tool").agg(F.count("*").alias("n"))


@query("sarif_document", f"""WITH findings AS ({K.FINDINGS}), t AS (SELECT *,
  CASE WHEN scan_id % 10 <> 0 THEN 'srv-' || scan_id ELSE '' END AS target FROM findings)
  SELECT rule_id, {_LEVEL} AS level, title || CASE WHEN detail <> '' THEN '. ' || detail ELSE '' END
      || coalesce(' Fix: ' || remediation, '') AS message,
    CASE WHEN target <> '' THEN 'mcp-server/' || target ELSE 'mcp-server' END AS uri,
    target || coalesce('/' || tool, '') AS logical_name FROM t
  UNION ALL SELECT DISTINCT rule_id, 'rule', '', '', '' FROM findings""")
def sarif_document(spark, sf):
    """All findings as one SARIF file, read back in splits."""
    from ..session import shared_dir
    path = shared_dir(spark, "sarif") + ".sarif"
    found = B.findings(spark, sf)
    report.sarif_document(report.sarif_results(found, _targets(spark, sf)), report.sarif_rules(found), path, "scan", "0.1.0")
    lines = documents.read_lines(spark, path).where(F.col("text").rlike(r'^\{"(ruleId|id)"'))
    item = lambda p: F.coalesce(F.get_json_object("text", p), F.lit(""))
    at = "$.locations[0]"
    is_rule = F.col("text").startswith('{"id"')
    return lines.select(F.coalesce(F.get_json_object("text", "$.ruleId"), item("$.id")).alias("rule_id"),
                        F.when(is_rule, "rule").otherwise(item("$.level")).alias("level"), item("$.message.text").alias("message"),
                        item(f"{at}.physicalLocation.artifactLocation.uri").alias("uri"),
                        item(f"{at}.logicalLocations[0].name").alias("logical_name"))


@query("snapshot_document", f"""WITH {K.LATEST}, {K.DRIFT_ROWS}, feed AS ({_RECENT}),
  board AS (SELECT * FROM summary ORDER BY token_estimate DESC, score, id LIMIT 20)
  SELECT identifier AS name, token_estimate AS value FROM summary UNION ALL SELECT identifier, token_estimate FROM board
  UNION ALL SELECT server_identifier, NULL FROM feed UNION ALL SELECT 'total', count(*) FROM summary""")
def snapshot_document(spark, sf):
    """The snapshot as one JSON file, read back in splits."""
    from ..session import shared_dir
    path = shared_dir(spark, "snapshot") + ".json"
    summary = stored(_summary(spark, sf), "summary")
    servers, events = B.index_servers(spark, sf), B.index_events(spark, sf)
    index.snapshot_document(index.snapshot(summary, index.stats(summary, events, _as_of()),
                                           index.recent_drift(events, servers), _as_of(), "0.1.0"), path)
    item = lambda key: F.get_json_object("text", f"$.{key}")
    name = F.coalesce(item("identifier"), item("server_identifier"), F.when(item("total_servers").isNotNull(), "total"))
    return documents.read_lines(spark, path).select(
        name.alias("name"), F.coalesce(item("token_estimate"), item("total_servers")).cast("bigint").alias("value")).where("name IS NOT NULL")


@query("text_hygiene", r"""
  WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || chr(27) || '[2J' WHEN 1 THEN text || chr(8238) || 'gnp'
    WHEN 2 THEN text || chr(155) || chr(9) ELSE text END AS text FROM documents)
  SELECT doc_id, regexp_matches(text,
    '[\x00-\x1f\x{7f}-\x{9f}\x{061c}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]') AS hostile,
    replace(replace(replace(replace(replace(replace(text, chr(27), '\x1b'), chr(8238), '\u202e'), chr(155), '\u009b'),
      chr(9), '\x09'), chr(10), '\x0a'), chr(13), '\x0d') AS safe_text FROM t""")
def text_hygiene(spark, sf):
    hostile = F.when(F.col("doc_id") % 5 == 0, F.lit("\x1b[2J")).when(F.col("doc_id") % 5 == 1, F.lit("\u202egnp")).when(
        F.col("doc_id") % 5 == 2, F.lit("\x9b\t")).otherwise(F.lit(""))
    docs = B.table(spark, sf, "documents").select("doc_id", F.concat("text", hostile).alias("text"))
    return report.text_hygiene(docs, "text").drop("text")


@query("byte_hygiene", r"""
  WITH t AS (SELECT doc_id, doc_id % 4 AS kind, text FROM documents)
  SELECT doc_id, kind <> 3 OR regexp_matches(text,
    '[\x00-\x1f\x{7f}-\x{9f}\x{061c}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]') AS hostile,
    replace(replace(replace(replace(text, chr(9), '\x09'), chr(10), '\x0a'), chr(13), '\x0d'), chr(155), '\u009b')
      || CASE kind WHEN 0 THEN '\xffb' WHEN 1 THEN '\xe2\x82(' WHEN 2 THEN '\xed\xa0\x80é' ELSE '' END AS safe_text FROM t""")
def byte_hygiene(spark, sf):
    """Texts as bytes, three of four with bytes that are no UTF-8: a lone one, a cut character, a surrogate."""
    kind = F.col("doc_id") % 4
    tail = F.when(kind == 0, F.unhex(F.lit("ff62"))).when(kind == 1, F.unhex(F.lit("e28228"))).when(
        kind == 2, F.unhex(F.lit("eda080c3a9"))).otherwise(F.unhex(F.lit("")))
    docs = B.table(spark, sf, "documents").select("doc_id", F.concat(F.col("text").cast("binary"), tail).alias("raw"))
    return report.text_hygiene(docs, "raw").drop("raw")


@query("scan_report_counts", None)
def scan_report_counts(spark, sf):
    """Captures from JSON to findings: how often each rule fires over all captures."""
    tools = captures.tools_table(captures.ingest_manifests(B.captures(spark, sf), canonical=False))
    return scan_findings(ScanInputs(tools)).groupBy("rule_id", "severity").agg(F.count("*").alias("findings"))
