"""Building blocks of the check SQL: the bridge and the fixed values, stated for DuckDB."""

from __future__ import annotations

from .. import constants as C
from . import bridge as B

COMPACT_SCHEMA_CASE = B.pick("doc_id", 6, [s.replace(" ", "") for s in B.SCHEMAS], "NULL")
#: Property names of the bridge's schemas, sorted, read off by hand.
PROPERTY_CASE = B.pick("doc_id", 6, ("path", "args command", "", "q url", ""), "''")
#: Nesting of the bridge's schemas, counted by hand.
DEPTH_CASE = B.pick("doc_id", 6, ("3", "3", "7", "6", "1"), "'0'")

TOOLS = f"""
  SELECT doc_id - doc_id % 4 AS scan_id, doc_id % 4 AS pos, 't' || doc_id AS name,
         text || {B.PHRASE_CASE} AS description, {B.SCHEMA_CASE} AS input_schema,
         {COMPACT_SCHEMA_CASE} AS compact_schema, {PROPERTY_CASE} AS props,
         CAST({DEPTH_CASE} AS BIGINT) AS depth, doc_id, source
  FROM documents"""

SPACE = (r"\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")


def token_count(text: str) -> str:
    return f"len(regexp_extract_all({text}, '\\p{{L}}{{1,4}}|\\p{{Nd}}{{1,3}}|[^\\p{{L}}\\p{{Nd}}{SPACE}]'))"


def serialized(name: str, description: str, schema: str) -> str:
    text = (f"'{{\"description\":' || CAST(to_json({description}) AS VARCHAR) || "
            f"coalesce(',\"inputSchema\":' || {schema}, '') || ',\"name\":' || "
            f"CAST(to_json({name}) AS VARCHAR) || '}}'")
    for char in "<>&":
        text = f"replace({text}, '{char}', '\\u{ord(char):04x}')"
    return text


def rounded(base: str, factor: float) -> str:
    return f"CAST(floor(greatest({base} * CAST({factor} AS DOUBLE), 1) + 0.5) AS BIGINT)"


def rule_match(rule: dict, text: str) -> str:
    return "(" + " OR ".join(
        "regexp_matches({}, '{}')".format(text, p.replace("'", "''")) for p in rule["any"]) + ")"


def words_match(words, text: str) -> str:
    return f"regexp_matches({text}, '(?i)\\b({'|'.join(words)})\\b')"


def class_list(name: str, description: str, props: str) -> str:
    """Sorted list of capability classes."""
    text = f"lower({name} || chr(10) || {description})"
    arms = [f"CASE WHEN {words_match(words, text)} OR {words_match(names, props)} THEN '{cls}' END"
            for cls, words, names in sorted(C.CAPABILITY_WORDS)]
    return f"list_filter([{', '.join(arms)}], lambda x: x IS NOT NULL)"


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str | None, *values: str) -> str:
    if template is None:
        return "CAST(NULL AS VARCHAR)"
    parts = template.split("{}")
    out = [sql_text(parts[0])]
    for piece, value in zip(parts[1:], values):
        out += [f"CAST({value} AS VARCHAR)", sql_text(piece)]
    return " || ".join(out)


def finding(rule: str, seq: str, *, rule_id: str | None = None, severity: str | None = None, title=(), detail=(),
            tool: str = "CAST(NULL AS VARCHAR)", remediation=(), detail_sql: str | None = None) -> str:
    """Select list of one finding."""
    fixed, head, text, fix = C.TEXTS[rule]
    return (f"{sql_text(rule) if rule_id is None else rule_id} AS rule_id, "
            f"{sql_text(fixed) if severity is None else severity} AS severity, "
            f"{filled(head, *title)} AS title, {detail_sql or filled(text, *detail)} AS detail, "
            f"{tool} AS tool, {filled(fix, *remediation)} AS remediation, CAST({seq} AS BIGINT) AS seq")


#: Columns of the findings table the checks compare.
FINDING_COLUMNS = ("scan_id", "rule_id", "severity", "title", "detail", "tool", "remediation", "seq")

SEVERITY_ROWS = ", ".join(f"('{n}', {r}, {p})" for n, r, p in C.SEVERITIES)
GRADE_CASE = ("CASE " + " ".join(f"WHEN score >= {floor} THEN '{g}'" for g, floor in C.GRADE_FLOORS)
              + f" ELSE '{C.LOWEST_GRADE}' END")

FINDINGS = f"""
  SELECT event_id - event_id % 5 AS scan_id,
         ['context','capability','injection','supplychain','authposture','drift'][user_id % 6 + 1] AS analyzer,
         user_id % 6 AS analyzer_ord, event_id AS seq, 'rule.r' || (user_id % 3) AS rule_id,
         {B.SEVERITY_CASE} AS severity, 'Event ' || event_type AS title,
         CASE WHEN event_id % 4 = 0 THEN '' ELSE props END AS detail,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'tool' || (event_id % 2) END AS tool,
         CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'Look at it.' END AS remediation
  FROM events"""
SCANS = """
  SELECT event_id - event_id % 5 AS scan_id FROM events
  UNION SELECT -1 - (event_id - event_id % 10) FROM events"""
FIRST = f"""
  SELECT f.scan_id, f.rule_id, coalesce(f.tool, '') AS tool, s.penalty AS points, f.severity,
         row_number() OVER (PARTITION BY f.scan_id, f.rule_id, coalesce(f.tool, '')
                            ORDER BY analyzer_ord, seq, coalesce(tool, ''), title) AS nth
  FROM findings f JOIN (VALUES {SEVERITY_ROWS}) s(name, rank, penalty) ON s.name = f.severity"""

VERSIONS = f"""
  base AS (SELECT doc_id - doc_id % 4 AS scan_id, doc_id,
           (CASE WHEN doc_id % 10 = 3 THEN 'old' ELSE 't' END) || doc_id AS name, nfc_normalize(text) AS text,
           coalesce({B.CANONICAL_SCHEMA_CASE}, '') AS schema, {PROPERTY_CASE} AS props FROM documents),
  cur AS (SELECT doc_id - doc_id % 4 AS scan_id, doc_id, 't' || doc_id AS name,
          nfc_normalize(CASE doc_id % 6 WHEN 0 THEN text || '{B.STEERING}' WHEN 1 THEN replace(text, ' ', '')
          WHEN 2 THEN text || ' More.' ELSE text END) AS text,
          CASE WHEN doc_id % 5 = 2 THEN '{B.CANONICAL_SCHEMAS[1]}'
               ELSE coalesce({B.CANONICAL_SCHEMA_CASE}, '') END AS schema,
          CASE WHEN doc_id % 5 = 2 THEN 'args command' ELSE {PROPERTY_CASE} END AS props FROM documents),
  pairs AS (SELECT coalesce(b.scan_id, c.scan_id) AS scan_id, coalesce(b.name, c.name) AS name,
            b.text AS old, c.text AS new, b.schema AS old_schema, c.schema AS new_schema,
            b.props AS old_props, c.props AS new_props
            FROM base b FULL JOIN cur c ON b.scan_id = c.scan_id AND b.name = c.name),
  tool_changes AS (
    SELECT scan_id, 'tool_added' AS kind, name AS target, NULL AS before, new AS after FROM pairs WHERE old IS NULL
    UNION ALL SELECT scan_id, 'tool_removed', name, NULL, NULL FROM pairs WHERE new IS NULL
    UNION ALL SELECT scan_id, 'tool_description_changed', name, old, new FROM pairs WHERE old <> new
    UNION ALL SELECT scan_id, 'tool_schema_changed', name, old_schema, new_schema FROM pairs
              WHERE old_schema <> new_schema)"""

HEADERS = """
  heads AS (SELECT DISTINCT doc_id - doc_id % 4 AS scan_id, source, doc_id FROM documents WHERE doc_id % 4 = 0),
  version_changes AS (
    SELECT scan_id, 'server_version_changed' AS kind, source AS target, '1.' || (doc_id % 3) AS before,
           '1.' || (doc_id % 2) AS after FROM heads WHERE doc_id % 3 <> doc_id % 2)"""


def presence(what: str, old: str, new: str) -> str:
    scan = "doc_id - doc_id % 4 AS scan_id"
    return f"""
  {what}_old AS (SELECT DISTINCT {scan}, {old} AS k FROM documents),
  {what}_new AS (SELECT DISTINCT {scan}, {new} AS k FROM documents),
  {what}_changes AS (
    SELECT scan_id, '{what}_added' AS kind, k AS target, NULL AS before, NULL AS after
    FROM (SELECT * FROM {what}_new EXCEPT SELECT * FROM {what}_old)
    UNION ALL SELECT scan_id, '{what}_removed', k, NULL, NULL
    FROM (SELECT * FROM {what}_old EXCEPT SELECT * FROM {what}_new))"""


RESOURCES = presence("resource", "lang || '://' || (doc_id % 3)", "lang || '://' || (doc_id % 5)")
PROMPTS = presence("prompt", "'p' || (doc_id % 3)", "'p' || (doc_id % 5)")
CHANGES = f"""{VERSIONS}, {HEADERS}, {RESOURCES}, {PROMPTS},
  changes AS (SELECT * FROM tool_changes UNION ALL SELECT * FROM version_changes
              UNION ALL SELECT * FROM resource_changes UNION ALL SELECT * FROM prompt_changes)"""

LATEST = f"""
  scans AS (SELECT o_orderkey AS id, o_custkey AS server_id, CAST(o_orderdate AS TIMESTAMP) AS scanned_at,
            o_orderstatus AS version, CAST(round_even(o_totalprice - 0.5, 0) AS BIGINT) AS whole,
            substring(o_orderpriority, 1, 1) AS manifest_hash, o_totalprice FROM orders),
  graded AS (SELECT *, CAST(trunc(o_totalprice) AS BIGINT) % 101 AS score FROM scans),
  latest AS (SELECT id AS scan_id, server_id, scanned_at, version, manifest_hash, score, {GRADE_CASE} AS grade
             FROM (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY scanned_at DESC, id DESC) AS nth
                   FROM graded) WHERE nth = 1),
  servers AS (SELECT c_custkey AS id, CASE c_nationkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' WHEN 2 THEN 'oci'
              ELSE 'http' END AS source, c_name AS identifier,
              CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE 'https://' || c_mktsegment END AS canonical_url,
              CASE WHEN c_nationkey % 7 = 0 THEN NULL ELSE 'official' END AS registry FROM customer),
  counts AS (SELECT l_orderkey AS scan_id, count(*) FILTER (l_linenumber % 5 = 0) AS critical,
             count(*) FILTER (l_linenumber % 5 = 1) AS high, count(*) FILTER (l_linenumber % 5 = 2) AS medium,
             count(*) FILTER (l_linenumber % 5 = 3) AS low, count(*) FILTER (l_linenumber % 5 = 4) AS info
             FROM lineitem WHERE l_orderkey IN (SELECT scan_id FROM latest) GROUP BY 1),
  tool_totals AS (SELECT l_orderkey AS scan_id, count(*) AS tool_count,
             CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS token_estimate
             FROM lineitem WHERE l_orderkey IN (SELECT scan_id FROM latest) GROUP BY 1),
  summary AS (SELECT s.id, s.source, s.identifier, coalesce(canonical_url, '') AS canonical_url,
              coalesce(registry, '') AS registry, coalesce(version, '') AS version, grade, score, manifest_hash,
              coalesce(tool_count, 0) AS tool_count, coalesce(token_estimate, 0) AS token_estimate,
              coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, epoch_us(scanned_at) AS scanned_at
              FROM servers s JOIN latest l ON l.server_id = s.id LEFT JOIN counts c ON c.scan_id = l.scan_id
              LEFT JOIN tool_totals t ON t.scan_id = l.scan_id)"""
LATEST = LATEST.replace("CAST(round_even(o_totalprice - 0.5, 0) AS BIGINT) AS whole,\n            ", "")

DRIFT_ROWS = f"""
  drift AS (SELECT event_id AS id, user_id AS server_id, 'tool_' || event_type AS kind, {B.SEVERITY_CASE} AS severity,
            't' || (user_id % 9) AS target, ts AS detected_at FROM events)"""

SPECS = """
  specs AS (SELECT p_partkey AS scan_id, p_partkey, p_size, p_name,
    CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN '@evil/mcp-server-' || p_type WHEN 2 THEN '@evil/server-postgres'
      WHEN 3 THEN 'mcp-server-ftch' WHEN 4 THEN 'mcp-server-git' ELSE '@parts/' || replace(p_name, ' ', '-') END AS name,
    CASE p_partkey % 8 WHEN 3 THEN CAST(p_partkey AS VARCHAR) WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN ''
      WHEN 4 THEN '' ELSE '1.' || p_partkey END AS version,
    CASE p_partkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' ELSE '' END AS ecosystem
    FROM part WHERE p_partkey % 8 <> 0 AND p_partkey % 11 <> 0),
  known AS (SELECT *, TIMESTAMP '2024-01-01' - to_days(CAST(p_size AS INT)) AS created FROM specs
    WHERE p_partkey % 8 >= 5 AND p_partkey % 3 <> 2 AND p_partkey % 13 <> 5)"""
AS_OF = "2024-01-15 00:00:00"
