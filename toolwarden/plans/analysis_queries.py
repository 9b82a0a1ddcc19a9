"""Queries over tools: injection, capability, cost, supply chain, posture."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import detect, jsontext, tokens
from ..operators import capability, cost, injection, posture, supply
from ..sources import packages
from ..sources import rules as rule_files
from ..sources import traces
from . import bridge as B
from . import checks as K
from .registry import query

RULES = {r["id"]: r for r in C.INJECTION_RULES}


def shown(findings):
    return findings.select(*K.FINDING_COLUMNS)


# --- injection ---------------------------------------------------------------

def _rules_sql(rules) -> str:
    parts = []
    for i, rule in enumerate(rules):
        parts.append(
            f"SELECT scan_id, '{rule['id']}' AS rule_id, '{rule['severity']}' AS severity, "
            f"{K.sql_text(rule['title'])} AS title, {K.sql_text(rule.get('detail') or '')} AS detail, name AS tool, "
            f"{K.sql_text(rule.get('remediation') or '')} AS remediation, CAST(pos * 10000 + {i} AS BIGINT) AS seq "
            f"FROM tools WHERE {K.rule_match(rule, 'name || chr(10) || description')}")
    return f"WITH tools AS ({K.TOOLS}) " + " UNION ALL ".join(parts)


@query("rule_findings", _rules_sql(C.INJECTION_RULES))
def rule_findings(spark, sf):
    return shown(injection.rule_findings(B.tools(spark, sf)))


CUSTOM_RULES = {"version": 2, "rules": [
    {"id": "custom.shell", "severity": "medium", "title": "Mentions a shell", "detail": "See text.",
     "remediation": "", "any": [r"(?i)\bshell\b", r"\bbash$"]},
    {"id": "custom.first_person", "severity": "odd", "title": "Has a long word", "any": [r"\b\w{14,}\b"]},
]}


@query("custom_rules", _rules_sql([{**r, "severity": {"odd": "info"}.get(r["severity"], r["severity"])}
                                   for r in CUSTOM_RULES["rules"]]))
def custom_rules(spark, sf):
    rules = rule_files.parse_rules(spark, CUSTOM_RULES).rules
    found = injection.injection_findings(B.tools(spark, sf), rules)
    return shown(found.where(F.col("rule_id").startswith("custom.")))


_HIDDEN = r"""
  WITH tools AS ({tools}), chars AS (
    SELECT *, regexp_matches(description, '[\x{{200b}}-\x{{200d}}\x{{feff}}]') AS zero,
      regexp_matches(description, '[\x{{202a}}-\x{{202e}}\x{{2066}}-\x{{2069}}]') AS bidi,
      regexp_matches(description,
        '^[^\x{{200b}}-\x{{200d}}\x{{feff}}\x{{202a}}-\x{{202e}}\x{{2066}}-\x{{2069}}]*[\x{{202a}}-\x{{202e}}\x{{2066}}-\x{{2069}}]')
        AS bidi_first,
      len(list_filter(regexp_extract_all(description, '\p{{L}}+'), lambda w: regexp_matches(w, '\p{{Latin}}')
        AND regexp_matches(w, '[\p{{Cyrillic}}\p{{Greek}}]'))) > 0 AS mixed
    FROM tools), reasons AS (
    SELECT *, array_to_string(list_filter([
      CASE WHEN bidi_first THEN 'bidirectional control characters' END,
      CASE WHEN zero THEN 'zero-width characters' END,
      CASE WHEN bidi AND NOT bidi_first THEN 'bidirectional control characters' END,
      CASE WHEN mixed THEN 'mixed-script (homoglyph) text' END], lambda x: x IS NOT NULL), ' and ') AS reason FROM chars)
""".format(tools=K.TOOLS)


@query("invisible_chars", _HIDDEN + "SELECT scan_id, " + K.finding(
    "injection.invisible_chars", "pos * 10000 + 9997", tool="name", detail=("reason",))
    + " FROM reasons WHERE reason <> ''")
def invisible_chars(spark, sf):
    found = injection.structural_findings(B.tools(spark, sf))
    return shown(found.where("rule_id = 'injection.invisible_chars'"))


@query("mixed_script_word", _HIDDEN + "SELECT scan_id, name, mixed FROM reasons")
def mixed_script_word(spark, sf):
    return B.tools(spark, sf).select("scan_id", "name",
                                     detect.mixed_script_word(F.col("description")).alias("mixed"))


@query("encoded_blob", rf"""
  WITH tools AS ({K.TOOLS}), runs AS (
    SELECT *, list_filter(regexp_extract_all(description, '[A-Za-z0-9+/=]{{24,}}'),
      lambda r: length(r) % 4 = 0 AND regexp_full_match(r, '[A-Za-z0-9+/]+={{0,2}}')) AS strict FROM tools),
  decoded AS (SELECT *, list_filter(list_transform(strict, lambda r: from_base64(r)),
      lambda b: octet_length(b) >= 8 AND len(regexp_extract_all(hex(b), '(?:[0-9A-F]{{2}})')) > 0) AS blobs FROM runs),
  texts AS (SELECT *, list_filter(blobs, lambda b:
      length(regexp_replace(regexp_replace(hex(b), '..', '\0,', 'g'), '([2-6][0-9A-F]|7[0-9A-E]),', '', 'g')) / 3.0
      < 0.15 * octet_length(b)) AS good FROM decoded)
  SELECT scan_id, {K.finding("injection.encoded_blob", "pos * 10000 + 9998", tool="name",
                             detail=("'\"' || decode(good[1])[1:40] || '\"'",))}
  FROM texts WHERE len(good) > 0""")
def encoded_blob(spark, sf):
    found = injection.structural_findings(B.tools(spark, sf))
    return shown(found.where("rule_id = 'injection.encoded_blob'"))


@query("excessive_length", f"WITH tools AS ({K.TOOLS}) SELECT scan_id, " + K.finding(
    "injection.excessive_length", "pos * 10000 + 9999", tool="name", detail=("length(description)",))
    + " FROM tools WHERE length(description) > 1500")
def excessive_length(spark, sf):
    found = injection.structural_findings(B.tools(spark, sf))
    return shown(found.where("rule_id = 'injection.excessive_length'"))


# --- capability --------------------------------------------------------------

_CLASSES = f"""WITH tools AS ({K.TOOLS}),
  classified AS (SELECT *, {K.class_list("name", "description", "props")} AS classes FROM tools)"""


@query("schema_property_names", f"WITH tools AS ({K.TOOLS}) SELECT scan_id, name, props FROM tools")
def schema_property_names(spark, sf):
    names = jsontext.schema_property_names(F.col("input_schema"))
    return B.tools(spark, sf).select("scan_id", "name", F.array_join(
        F.array_sort(F.split(names, " ")), " ").alias("props"))


@query("classify_tool", _CLASSES + "SELECT scan_id, name, array_to_string(classes, ' ') AS classes FROM classified")
def classify_tool(spark, sf):
    return capability.classify_tools(B.tools(spark, sf)).select("scan_id", "name", "classes")


@query("capability_summary", _CLASSES + """
  , exploded AS (SELECT scan_id, unnest(classes) AS class FROM classified)
  SELECT s.scan_id, coalesce(u.classes, '') AS classes, s.tools_with_classes FROM
    (SELECT scan_id, count(*) FILTER (len(classes) > 0) AS tools_with_classes FROM classified GROUP BY 1) s
    LEFT JOIN (SELECT scan_id, string_agg(DISTINCT class, ' ' ORDER BY class) AS classes FROM exploded GROUP BY 1) u
    ON u.scan_id = s.scan_id""")
def capability_summary(spark, sf):
    return capability.capability_summary(B.tools(spark, sf))


@query("capability_by_tool", _CLASSES + """
  SELECT scan_id, pos, name AS tool, array_to_string(classes, ' ') AS classes FROM classified WHERE len(classes) > 0""")
def capability_by_tool(spark, sf):
    return capability.capability_by_tool(B.tools(spark, sf))


_DANGER = ", ".join(f"('{c}', {i})" for i, c in enumerate(sorted(C.DANGEROUS_CLASSES)))


@query("declared_findings", _CLASSES + f"""
  SELECT scan_id, {K.finding("capability.declared", "pos * 10000 + d.i",
         rule_id="'capability.declared_' || replace(d.c, ':', '_')", title=("d.c",), detail=("name", "d.c"), tool="name")}
  FROM classified JOIN (VALUES {_DANGER}) d(c, i) ON list_contains(classes, d.c)""")
def declared_findings(spark, sf):
    return shown(capability.declared_findings(B.tools(spark, sf)))


_RUNS = """
  runs AS (SELECT DISTINCT user_id * 8 AS scan_id, user_id % 3 <> 0 AS net_denied, user_id % 10 = 7 AS unobserved
           FROM events),
  calls AS (SELECT DISTINCT user_id * 8 AS scan_id, event_type,
    '203.0.113.' || (event_id % 4) || CASE WHEN event_id % 5 = 0 THEN ':53' ELSE ':443' END AS remote,
    CASE WHEN event_id % 5 = 0 THEN 'dns' ELSE 'egress' END AS remote_kind, user_id % 2 = 0 AS stub,
    CASE event_id % 90 WHEN 0 THEN '.ssh/id_rsa' WHEN 1 THEN '.env' WHEN 2 THEN '.aws/credentials' END AS decoy
    FROM events),
  facts AS (SELECT scan_id, remote_kind AS kind, remote AS what FROM calls WHERE event_type = 'error'
    UNION SELECT scan_id, 'dns', '127.0.0.53:8080' FROM calls WHERE event_type = 'purchase' AND stub
    UNION SELECT scan_id, 'decoy', decoy FROM calls WHERE event_type = 'click' AND decoy IS NOT NULL),
  traces AS (SELECT r.scan_id, r.net_denied, r.unobserved,
    coalesce(string_agg(what, '{sep}' ORDER BY what) FILTER (kind = 'decoy'), '') AS decoy_reads,
    coalesce(string_agg(what, '{sep}' ORDER BY what) FILTER (kind = 'egress'), '') AS egress_hosts,
    coalesce(string_agg(what, '{sep}' ORDER BY what) FILTER (kind = 'dns'), '') AS dns_resolve
    FROM runs r LEFT JOIN facts f ON f.scan_id = r.scan_id GROUP BY ALL)"""


def _traces(spark, sf):
    return traces.trace_behavior(B.trace_lines(spark, sf), B.trace_runs(spark, sf))


@query("trace_behavior", f"""WITH {_RUNS.format(sep=' ')}
  SELECT scan_id, decoy_reads, egress_hosts, dns_resolve, net_denied,
         CASE WHEN unobserved THEN 'strace is not installed' ELSE '' END AS unobserved FROM traces""")
def trace_behavior(spark, sf):
    return _traces(spark, sf).drop(*[f"more_{c}" for c in traces.KINDS.values()])


@query("trace_observations", f"WITH {_RUNS.format(sep=' ')} SELECT * FROM facts")
def trace_observations(spark, sf):
    """Every path, address and lookup of every run as a row of its own."""
    return traces.observations(B.trace_lines(spark, sf))


_SERVER = str(1 << 50)


@query("observed_decoy_read", f"WITH {_RUNS.format(sep=', ')} SELECT scan_id, " + K.finding(
    "capability.decoy_read", _SERVER, detail=("decoy_reads",))
    + " FROM traces WHERE NOT unobserved AND decoy_reads <> ''")
def observed_decoy_read(spark, sf):
    return shown(capability.observed_decoy_read(_traces(spark, sf)))


@query("observed_egress", f"WITH {_RUNS.format(sep=', ')} SELECT scan_id, " + K.finding(
    "capability.egress_unexpected", f"{_SERVER} + 1", detail=("egress_hosts",))
    + " FROM traces WHERE NOT unobserved AND net_denied AND egress_hosts <> ''")
def observed_egress(spark, sf):
    return shown(capability.observed_egress(_traces(spark, sf)))


@query("declared_observed_gap", f"""{_CLASSES}, {_RUNS.format(sep=', ')}
  SELECT scan_id, {K.finding("capability.declared_observed_gap", f"{_SERVER} + 2")}
  FROM traces t WHERE NOT unobserved AND net_denied AND egress_hosts <> ''
  AND NOT EXISTS (SELECT 1 FROM classified c WHERE c.scan_id = t.scan_id AND list_contains(classes, 'net:egress'))""")
def declared_observed_gap(spark, sf):
    summary = capability.capability_summary(B.tools(spark, sf))
    return shown(capability.declared_observed_gap(_traces(spark, sf), summary))


@query("not_observed", f"WITH {_RUNS.format(sep=', ')} SELECT scan_id, " + K.finding(
    "capability.not_observed", _SERVER, detail=("'strace is not installed'",)) + " FROM traces WHERE unobserved")
def not_observed(spark, sf):
    return shown(capability.not_observed(_traces(spark, sf)))


# --- context cost ------------------------------------------------------------

_TOKENS = f"""WITH tools AS ({K.TOOLS}),
  texts AS (SELECT *, {K.serialized("name", "description", "compact_schema")} AS txt FROM tools),
  counted AS (SELECT *, {K.token_count("txt")} AS base FROM texts)"""
_TURNS = f"""WITH texts AS (SELECT conv_id AS scan_id, turn AS pos, role || '_' || turn AS name,
    {K.serialized("role || '_' || turn", "text", "NULL")} AS txt FROM conversations),
  counted AS (SELECT *, {K.rounded(K.token_count("txt"), 1.0)} AS tokens FROM texts)"""


@query("serialize_tool", _TOKENS + " SELECT scan_id, name, sha256(txt) AS digest, strlen(txt) AS bytes FROM counted")
def serialize_tool(spark, sf):
    text = tokens.serialize_tool(F.col("name"), F.col("description"), F.col("input_schema"))
    return B.tools(spark, sf).select("scan_id", "name", F.sha2(text, 256).alias("digest"),
                                     F.octet_length(text).alias("bytes"))


@query("token_estimate", f"""
  SELECT doc_id, {K.token_count("text")} AS base, CASE WHEN text = '' THEN 0 ELSE
         {K.rounded(K.token_count("text"), 1.05)} END AS tokens FROM documents""")
def token_estimate(spark, sf):
    text = F.col("text")
    return B.table(spark, sf, "documents").select(
        "doc_id", tokens.token_base(text).alias("base"), tokens.token_estimate(text, 1.05).alias("tokens"))


@query("model_cost", _TOKENS + ", sums AS (SELECT scan_id, count(*) AS tool_count, " + ", ".join(
    f"CAST(sum({K.rounded('base', m[3])}) AS BIGINT) AS t{i}" for i, m in enumerate(C.MODELS))
    + " FROM counted GROUP BY 1) " + " UNION ALL ".join(
    f"SELECT scan_id, tool_count, '{m[0]}' AS model, '{m[1]}' AS family, t{i} AS tokens, "
    f"round(t{i} / CAST(1000000 AS DOUBLE) * CAST({m[2]} AS DOUBLE), 9) AS usd_per_request FROM sums"
    for i, m in enumerate(C.MODELS)))
def model_cost(spark, sf):
    return cost.model_cost(B.tools(spark, sf)).withColumn("usd_per_request", F.round("usd_per_request", 9))


@query("per_tool_tokens", _TURNS + """
  SELECT scan_id, pos, name AS tool, tokens,
         row_number() OVER (PARTITION BY scan_id ORDER BY tokens DESC, pos) AS rank FROM counted""")
def per_tool_tokens(spark, sf):
    return cost.per_tool_tokens(B.turns(spark, sf))


@query("schema_depth", f"WITH tools AS ({K.TOOLS}) SELECT scan_id, name, depth FROM tools")
def schema_depth(spark, sf):
    return cost.schema_depth(B.tools(spark, sf)).select("scan_id", "name", "depth")


@query("schema_bloat", f"WITH tools AS ({K.TOOLS}) SELECT scan_id, " + K.finding(
    "context.schema_bloat", "pos * 10000", tool="name", detail=("depth",)) + " FROM tools WHERE depth > 5")
def schema_bloat(spark, sf):
    return shown(cost.schema_bloat(B.tools(spark, sf)))


def _oversized(counted: str) -> str:
    return f""", ranked AS (SELECT *, sum(tokens) OVER (PARTITION BY scan_id) AS total,
    count(*) OVER (PARTITION BY scan_id) AS n,
    row_number() OVER (PARTITION BY scan_id ORDER BY tokens DESC, pos) AS rank FROM {counted})
  SELECT scan_id, {K.finding("context.oversized_tool", _SERVER, tool="name",
         detail=("'\"' || name || '\"'", "CAST(round_even(tokens / total * 100, 0) AS BIGINT)"))}
  FROM ranked WHERE rank = 1 AND tokens / total > 0.4 AND tokens / total > 2.0 / n"""


#: The same check over documents as tools, for the union of all analyzers.
OVERSIZED_DOCUMENTS = _TOKENS + f", sized AS (SELECT *, {K.rounded('base', 1.0)} AS tokens FROM counted)" + _oversized("sized")


@query("oversized_tool", _TURNS + _oversized("counted"))
def oversized_tool(spark, sf):
    return shown(cost.oversized_tool(B.turns(spark, sf)))


# --- supply chain and posture --------------------------------------------------

_POPULAR = ", ".join(f"('{p}', {i})" for i, p in enumerate(C.POPULAR_PACKAGES))
_SQUATS = f"""WITH {K.SPECS},
  popular AS (SELECT * FROM (VALUES {_POPULAR}) p(target, place)),
  near AS (SELECT scan_id, name, target, levenshtein(split_part(name, '/', -1), split_part(target, '/', -1)) AS d,
    row_number() OVER (PARTITION BY scan_id ORDER BY
      levenshtein(split_part(name, '/', -1), split_part(target, '/', -1)), place) AS nth
    FROM specs JOIN popular ON true WHERE name NOT IN (SELECT target FROM popular)),
  squats AS (SELECT * FROM near WHERE nth = 1 AND d <= 2)"""
_Q = "'\"' || {} || '\"'"


def _as_of():
    return F.lit(K.AS_OF).cast("timestamp")


@query("typosquat", _SQUATS + f"""
  SELECT scan_id, rule_id, severity, title, detail, tool, remediation, seq FROM (
  SELECT d, scan_id, {K.finding("supplychain.typosquat", "0", detail=(_Q.format("name"), _Q.format("target")),
                             remediation=(_Q.format("target"), _Q.format("name")))} FROM squats WHERE d > 0
  UNION ALL
  SELECT d, scan_id, {K.finding("supplychain.same_name", "0", rule_id="'supplychain.typosquat'",
         detail=(_Q.format("name"), _Q.format("target")),
         remediation=(_Q.format("target"), _Q.format("name")))} FROM squats WHERE d = 0)""")
def typosquat(spark, sf):
    return shown(supply.typosquat(B.package_specs(spark, sf)))


_NAMES = """
  SELECT DISTINCT CASE p_partkey % 4
    WHEN 0 THEN '@parts/' || replace(p_name, ' ', '-') || '-' || lower(p_brand)
    WHEN 1 THEN '@other/' || replace(p_name, ' ', '-') || '-' || lower(p_brand)
    WHEN 2 THEN replace(replace(p_name, ' ', '-') || '-' || lower(p_brand), 'e', '')
    ELSE 'x' || replace(p_name, ' ', '') || '-' || lower(p_brand) END AS name FROM part"""
_REGISTRY = """
  SELECT '@parts/' || replace(p_name, ' ', '-') || '-' || lower(p_brand) AS name, min(p_partkey) AS place
  FROM part GROUP BY 1"""


@query("typosquat_registry", f"""WITH names AS ({_NAMES}), registry AS ({_REGISTRY}),
  near AS (SELECT n.name, r.name AS target, levenshtein(split_part(n.name, '/', -1), split_part(r.name, '/', -1)) AS d,
    row_number() OVER (PARTITION BY n.name ORDER BY
      levenshtein(split_part(n.name, '/', -1), split_part(r.name, '/', -1)), place, r.name) AS nth
    FROM names n JOIN registry r ON abs(length(split_part(n.name, '/', -1)) - length(split_part(r.name, '/', -1))) <= 2
    WHERE n.name NOT IN (SELECT name FROM registry))
  SELECT name, target, d = 0 AS same_name, d AS distance FROM near WHERE nth = 1 AND d <= 2""")
def typosquat_registry(spark, sf):
    part = B.table(spark, sf, "part")
    base = "replace(p_name, ' ', '-') || '-' || lower(p_brand)"
    names = part.selectExpr(
        f"CASE p_partkey % 4 WHEN 0 THEN '@parts/' || {base} WHEN 1 THEN '@other/' || {base} "
        f"WHEN 2 THEN replace({base}, 'e', '') ELSE 'x' || replace(p_name, ' ', '') || '-' || lower(p_brand) END AS name")
    registry = part.selectExpr(f"'@parts/' || {base} AS name", "p_partkey AS place")
    return supply.typosquat_registry(names, registry)


def _package(rule: str):
    def run(spark, sf):
        joined = supply.with_package(B.package_specs(spark, sf), B.packages(spark, sf))
        return shown(supply.package_findings(joined, _as_of()).where(F.col("rule_id") == f"supplychain.{rule}"))
    return run


_YOUNG = "TIMESTAMP '" + K.AS_OF + "'"
_PACKAGE_CHECKS = {
    "metadata_unavailable": (1, ("CASE WHEN ecosystem = '' THEN 'unsupported ecosystem \"\"' ELSE 'package not found' END",),
                             "FROM specs WHERE scan_id NOT IN (SELECT scan_id FROM known)"),
    "install_script": (2, (), "FROM known WHERE p_size % 7 = 0"),
    "no_source": (3, (), "FROM known WHERE p_size % 5 = 0"),
    "single_maintainer": (4, (), "FROM known WHERE ecosystem = 'npm' AND p_size % 4 = 1"),
    "young_package": (5, (f"date_diff('day', created, {_YOUNG})",),
                      f"FROM known WHERE p_size % 9 <> 0 AND created > {_YOUNG} - INTERVAL 30 DAYS"),
}
for _name, (_seq, _detail, _from) in _PACKAGE_CHECKS.items():
    query(_name, f"WITH {K.SPECS} SELECT scan_id, "
          + K.finding(f"supplychain.{_name}", str(_seq), detail=_detail) + " " + _from)(_package(_name))


@query("known_cve", f"""WITH {K.SPECS},
  hits AS (SELECT scan_id, 'ADV-' || l_orderkey || '-' || l_linenumber AS id, min('Flaw in ' || p_name) AS summary,
    CASE WHEN bool_or(l_returnflag = 'A') THEN 'high' ELSE 'medium' END AS level
    FROM known JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2)
  SELECT scan_id, {K.finding("supplychain.known_cve", "10", severity="level", title=("id",), detail_sql="summary",
                             remediation=("id",))} FROM hits""")
def known_cve(spark, sf):
    joined = supply.with_package(B.package_specs(spark, sf), B.packages(spark, sf))
    return shown(supply.known_cve(joined, B.advisory_rows(spark, sf)))


_RANGED = """ranged AS (SELECT 'ADV-' || l_orderkey || '-' || l_linenumber AS id, 'Flaw in ' || p_name AS summary,
    CASE WHEN l_returnflag = 'A' THEN 'critical' ELSE '' END AS severity,
    CASE p_partkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' ELSE 'other' END AS ecosystem,
    '@parts/' || replace(p_name, ' ', '-') AS name, l_orderkey % 5 AS kind, p_partkey AS part
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("known_cve_ranges", f"""WITH {K.SPECS}, {_RANGED},
  hits AS (SELECT scan_id, id, min(summary) AS summary, CASE WHEN bool_or(severity = 'critical') THEN 'high' ELSE 'medium' END AS level
    FROM known k JOIN ranged r ON k.name = r.name AND k.ecosystem = r.ecosystem
    WHERE CASE kind WHEN 0 THEN true WHEN 1 THEN k.p_partkey > part WHEN 2 THEN k.p_partkey = part
          WHEN 3 THEN false ELSE k.p_partkey <= part END GROUP BY 1, 2)
  SELECT scan_id, {K.finding("supplychain.known_cve", "10", severity="level", title=("id",), detail_sql="summary",
                             remediation=("id",))} FROM hits""")
def known_cve_ranges(spark, sf):
    """Advisories without listed versions: open, bounded and several intervals."""
    joined = supply.with_package(B.package_specs(spark, sf), B.packages(spark, sf))
    docs = B.advisory_documents(spark, sf)
    return shown(supply.known_cve(joined, packages.advisories(docs), packages.advisory_ranges(docs)))


@query("advisory_rejects", f"""WITH {_RANGED} SELECT id, summary, severity, ecosystem, name,
  'no versions and no version range' AS reason FROM ranged WHERE kind = 3""")
def advisory_rejects(spark, sf):
    return packages.advisory_rejects(B.advisory_documents(spark, sf))


@query("supplychain_gate", f"WITH {K.SPECS} SELECT scan_id, name, version, ecosystem FROM specs")
def supplychain_gate(spark, sf):
    return supply.in_scope(B.package_specs(spark, sf)).select("scan_id", "name", "version", "ecosystem")


_ENDPOINTS = """WITH e AS (SELECT page_id AS scan_id, CASE WHEN url LIKE 'https://%' THEN 'https' ELSE 'http' END AS scheme,
  CASE WHEN page_id % 7 = 0 THEN 0 ELSE 768 + page_id % 5 END AS tls, page_id % 3 = 0 AS open FROM pages) SELECT scan_id, """


@query("unauthenticated_listing", _ENDPOINTS + K.finding("authposture.unauthenticated_listing", "0") + " FROM e WHERE open")
def unauthenticated_listing(spark, sf):
    return shown(posture.posture_findings(B.endpoints(spark, sf), "unauthenticated_listing"))


@query("plaintext_http", _ENDPOINTS + K.finding("authposture.plaintext_http", "1") + " FROM e WHERE scheme = 'http'")
def plaintext_http(spark, sf):
    return shown(posture.posture_findings(B.endpoints(spark, sf), "plaintext_http"))


@query("weak_tls", _ENDPOINTS + K.finding("authposture.weak_tls", "2", detail=(
    "CASE tls WHEN 769 THEN 'TLS 1.0' WHEN 770 THEN 'TLS 1.1' ELSE 'an old TLS/SSL version' END",))
    + " FROM e WHERE scheme <> 'http' AND tls <> 0 AND tls < 771")
def weak_tls(spark, sf):
    return shown(posture.posture_findings(B.endpoints(spark, sf), "weak_tls"))
