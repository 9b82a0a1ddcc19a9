"""Queries over versions of a server: canonical forms, baselines, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import jsontext
from ..operators import drift, manifest
from ..session import shared_dir, stored
from ..sources import baselines as baseline_files
from ..sources import captures
from . import bridge as B
from . import checks as K
from .analysis_queries import shown
from .registry import query


def _manifests(spark, sf):
    return captures.ingest_manifests(B.captures(spark, sf))


_CAPTURED = f"""
  WITH docs AS (SELECT *, text || {B.PHRASE_CASE} AS description, {B.SCHEMA_CASE} AS schema,
                {B.CANONICAL_SCHEMA_CASE} AS canonical_schema FROM documents)"""


@query("nfc_normalize", f"WITH d AS (SELECT doc_id, replace(text, 'é', 'e' || chr(769)) AS text FROM documents) "
       "SELECT doc_id, nfc_normalize(text) AS text FROM d")
def nfc_normalize(spark, sf):
    decomposed = F.replace("text", F.lit("é"), F.lit("e\u0301"))
    return B.table(spark, sf, "documents").select("doc_id", jsontext.nfc(decomposed).alias("text"))


@query("canonical_json", r"""
  SELECT o_orderkey, '{"id":' || o_orderkey || ',"k":"' || o_orderpriority || '","n":{"a":null,"b":true},"p":'
         || regexp_replace(CAST(o_totalprice AS VARCHAR), '\.0$', '') || ',"z":[3,1,100,"<é>"]}' AS canonical
  FROM orders""")
def canonical_json(spark, sf):
    raw = ("""concat('{ "z": [3, 1.0, 1e2, "<é>"], "n": {"b": true, "a": null}, "p": ', """
           """CAST(o_totalprice AS DECIMAL(18, 2)), ', "k": "', o_orderpriority, '",\n "id": ', o_orderkey, '}')""")
    return B.table(spark, sf, "orders").selectExpr("o_orderkey", f"{raw} AS raw").select(
        "o_orderkey", jsontext.canonical_json(F.col("raw")).alias("canonical"))


@query("ingest_manifests", _CAPTURED + """
  SELECT doc_id AS scan_id, 'tool' AS part, CAST(pos AS BIGINT) AS pos, name, description, schema FROM (
    SELECT doc_id, 0 AS pos, 't' || doc_id || 'b' AS name, description, schema FROM docs
    UNION ALL SELECT doc_id, 1, 't' || doc_id || 'a', lang, NULL FROM docs) WHERE doc_id % 50 < 48
  UNION ALL SELECT doc_id, 'error', 0, CASE doc_id % 50 WHEN 49 THEN 'no tools result'
    ELSE 'tools result is not a tool list' END, NULL, NULL FROM docs WHERE doc_id % 50 >= 48
  UNION ALL SELECT doc_id, 'resource', r.pos, r.uri, r.mime, NULL FROM (
    SELECT doc_id, lang, unnest([{'pos': 0, 'uri': 'doc://' || doc_id, 'mime': 'text/plain'},
      {'pos': 1, 'uri': 'doc://' || (doc_id % 7), 'mime': ''}]) AS r
    FROM docs WHERE doc_id % 3 <> 0 AND doc_id % 50 < 48)
  UNION ALL SELECT doc_id, 'prompt', 0, 'p' || (doc_id % 5), lang, NULL FROM docs
    WHERE doc_id % 2 = 1 AND doc_id % 50 < 48""")
def ingest_manifests(spark, sf):
    m = captures.ingest_manifests(B.captures(spark, sf), canonical=False)
    null = F.lit(None).cast("string")
    tools = captures.tools_table(m).select("scan_id", F.lit("tool").alias("part"), "pos", "name", "description",
                                           F.col("input_schema").alias("schema"))
    errors = captures.failed(m).select("scan_id", F.lit("error"), F.lit(0), "error", null, null)
    resources = captures.resources_table(m).select("scan_id", F.lit("resource"), "pos", "uri", "mime_type", null)
    prompts = captures.prompts_table(m).select("scan_id", F.lit("prompt"), "pos", "name", "description", null)
    return tools.union(errors).union(resources).union(prompts)


_CANONICAL = _CAPTURED + """,
  quoted AS (SELECT *, CAST(to_json(nfc_normalize(description)) AS VARCHAR) AS q FROM docs WHERE doc_id % 50 < 48),
  parts AS (SELECT *,
    '{"name":"t' || doc_id || 'a","description":"' || lang || '"},{"name":"t' || doc_id || 'b","description":' || q
      || coalesce(',"input_schema":' || canonical_schema, '') || '}' AS tools,
    '{"uri":"doc://' || doc_id || '","name":"' || lang || '","description":"","mime_type":"text/plain"}' AS r1,
    '{"uri":"doc://' || (doc_id % 7) || '","name":"x","description":""}' AS r2 FROM quoted),
  canon AS (SELECT doc_id AS scan_id, 'http://' || source || '/' || doc_id AS target, source,
    '{"schema_version":"1","server":{"name":"' || source || '","version":"1.' || (doc_id % 3)
    || '","protocol_version":"2025-06-18"},"tools":[' || tools || '],"resources":['
    || CASE WHEN doc_id % 3 = 0 THEN '' WHEN CAST(doc_id AS VARCHAR) > CAST(doc_id % 7 AS VARCHAR)
       THEN r2 || ',' || r1 WHEN doc_id < 7 THEN r1 || ',' || r2 ELSE r1 || ',' || r2 END
    || '],"prompts":[' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE
       '{"name":"p' || (doc_id % 5) || '","description":"' || lang || '"}' END || ']}' AS canonical FROM parts)"""


@query("canonical_manifest", _CANONICAL + " SELECT scan_id, canonical FROM canon")
def canonical_manifest(spark, sf):
    return manifest.canonical_manifest(captures.captured(_manifests(spark, sf))).select("scan_id", "canonical")


@query("manifest_hash", _CANONICAL + " SELECT scan_id, sha256(canonical) AS manifest_hash FROM canon")
def manifest_hash(spark, sf):
    return manifest.manifest_hash(captures.captured(_manifests(spark, sf))).select("scan_id", "manifest_hash")


def _current(spark, sf):
    """The captures that worked, decoded once for all that reads them."""
    hashed = manifest.manifest_hash(captures.captured(_manifests(spark, sf)))
    return stored(hashed.select("scan_id", F.col("identifier").alias("target"), "server_name", "scanned_at", "canonical", "manifest_hash"),
                  "current")


def _recorded(rows):
    """Baselines of every source but one in four, some with another version recorded."""
    stamp = F.when(F.col("scan_id") % 5 == 0, F.replace("canonical", F.lit('"schema_version":"1"'),
                                                       F.lit('"schema_version":"0"'))).otherwise(F.col("canonical"))
    known = rows.where(F.col("scan_id") % 4 != 1).withColumn("canonical", stamp)
    return known.select("target", "server_name", F.sha2("canonical", 256).alias("manifest_hash"),
                        F.col("canonical").alias("manifest"), F.lit(1).alias("rubric_version"),
                        F.col("scanned_at").alias("recorded_at"))


_STATE = _CANONICAL + """, states AS (SELECT *, sha256(canonical) AS manifest_hash,
  CASE WHEN scan_id % 4 = 1 THEN 'first_scan' WHEN scan_id % 5 = 0 THEN 'drifted' ELSE 'unchanged' END AS baseline_state
  FROM canon)"""


@query("baseline_state", _STATE + " SELECT scan_id, target, baseline_state FROM states")
def baseline_state(spark, sf):
    current = _current(spark, sf)
    return manifest.baseline_state(current, _recorded(current)).select(
        "scan_id", "target", "baseline_state")


@query("put_baseline", _STATE + """ SELECT target, source AS server_name, CASE WHEN baseline_state = 'drifted'
  THEN sha256(replace(canonical, '"schema_version":"1"', '"schema_version":"0"')) ELSE manifest_hash END AS manifest_hash
  FROM states""")
def put_baseline(spark, sf):
    current = _current(spark, sf)
    return manifest.put_baseline(current, _recorded(current)).select(
        "target", "server_name", "manifest_hash")


@query("update_baseline", _STATE + " SELECT target, source AS server_name, manifest_hash FROM states")
def update_baseline(spark, sf):
    current = _current(spark, sf)
    return manifest.put_baseline(current, _recorded(current), update=True).select(
        "target", "server_name", "manifest_hash")


@query("read_baselines", _STATE + """ SELECT target, CASE WHEN baseline_state = 'drifted'
  THEN sha256(replace(canonical, '"schema_version":"1"', '"schema_version":"0"')) ELSE manifest_hash END AS manifest_hash
  FROM states WHERE baseline_state <> 'first_scan'""")
def read_baselines(spark, sf):
    path = shared_dir(spark, "baselines")
    baseline_files.write_baselines(_recorded(_current(spark, sf)), path)
    return baseline_files.read_baselines(spark, path).select("target", F.sha2("manifest", 256).alias("manifest_hash"))


@query("baseline_documents", _STATE + """ SELECT target, CASE WHEN baseline_state = 'drifted' THEN 'drifted' ELSE 'unchanged' END
    AS baseline_state, source AS server_name FROM states WHERE baseline_state <> 'first_scan'""")
def baseline_documents(spark, sf):
    """Baselines written as one JSON document, read back, and compared with the captures they came from."""
    path = shared_dir(spark, "baselines") + ".json"
    current = _current(spark, sf)
    baseline_files.write_baseline_document(_recorded(current), path)
    known = baseline_files.read_baseline_documents(spark, path)
    return manifest.baseline_state(current, known).where("baseline_state <> 'first_scan'").join(
        known.select("target", F.col("server_name").alias("recorded_name")), "target").select(
        "target", "baseline_state", F.col("recorded_name").alias("server_name"))


@query("verify_gate", _STATE + """ SELECT count(*) AS targets,
  count(*) FILTER (baseline_state = 'first_scan') AS errors, count(*) FILTER (baseline_state = 'drifted') AS drifted,
  CASE WHEN count(*) FILTER (baseline_state = 'first_scan') > 0 THEN 'error'
       WHEN count(*) FILTER (baseline_state = 'drifted') > 0 THEN 'drift' ELSE 'ok' END AS verdict FROM states""")
def verify_gate(spark, sf):
    current = _current(spark, sf)
    return manifest.verify_gate(current, _recorded(current))


# --- changes -------------------------------------------------------------------

def versions_of(spark, sf):
    """Both versions of every scan, as the tables a diff takes."""
    base_tools, cur_tools = B.versions(spark, sf)
    base, cur = {"tools": base_tools}, {"tools": cur_tools}
    for name, (old, new) in B.listings(spark, sf).items():
        base[name], cur[name] = old, new
    return base, cur


_TEXTS = "coalesce(sha256(before), '') AS before, coalesce(sha256(after), '') AS after"


def _digested(changes):
    digest = lambda c: F.coalesce(F.sha2(F.col(c), 256), F.lit("")).alias(c)
    return changes.select("scan_id", "kind", "target", digest("before"), digest("after"))


@query("manifest_diff", f"WITH {K.CHANGES} SELECT scan_id, kind, target, {_TEXTS} FROM changes")
def manifest_diff(spark, sf):
    return _digested(drift.manifest_diff(*versions_of(spark, sf)))


@query("tool_diff", f"WITH {K.VERSIONS} SELECT scan_id, kind, target, {_TEXTS} FROM tool_changes")
def tool_diff(spark, sf):
    return _digested(drift.tool_diff(*B.versions(spark, sf), classes=False))


@query("presence_diff", f"WITH {K.RESOURCES}, {K.PROMPTS} SELECT scan_id, kind, target FROM resource_changes "
       "UNION ALL SELECT scan_id, kind, target FROM prompt_changes")
def presence_diff(spark, sf):
    lists = B.listings(spark, sf)
    return (drift.presence_diff(*lists["resources"], "uri", "resource")
            .unionByName(drift.presence_diff(*lists["prompts"], "name", "prompt"))).select("scan_id", "kind", "target")


@query("version_changed", f"WITH {K.HEADERS} SELECT * FROM version_changes")
def version_changed(spark, sf):
    return drift.version_changed(*B.listings(spark, sf)["servers"])


@query("diff_order", f"WITH {K.CHANGES} SELECT scan_id, kind, target FROM changes ORDER BY scan_id, kind, target")
def diff_order(spark, sf):
    return drift.diff_order(drift.manifest_diff(*versions_of(spark, sf), texts=False)).select("scan_id", "kind", "target")


def _gained(pattern: str, old: str = "old", new: str = "new") -> str:
    return f"(regexp_matches({new}, '{pattern}') AND NOT regexp_matches({old}, '{pattern}'))"


@query("hijack_gained", f"""WITH {K.VERSIONS} SELECT scan_id, name, {_gained(C.STEERING_FINDING)} AS gained
  FROM pairs WHERE old IS NOT NULL AND new IS NOT NULL""")
def hijack_gained(spark, sf):
    base, cur = B.versions(spark, sf)
    old = base.select("scan_id", "name", F.col("description").alias("old"))
    both = old.join(cur.select("scan_id", "name", F.col("description").alias("new")), ["scan_id", "name"])
    return both.select("scan_id", "name", drift.steering_gained(F.col("old"), F.col("new")).alias("gained"))


_OLD_CLASSES = K.class_list("name", "old", "old_props")
_NEW_CLASSES = K.class_list("name", "new", "new_props")
_ESCALATED = f"""WITH {K.CHANGES}, escalated AS (SELECT *, array_to_string(list_filter({_NEW_CLASSES},
    lambda c: NOT list_contains({_OLD_CLASSES}, c)), '@SEP@') AS added
  FROM pairs WHERE old_schema <> new_schema)"""


@query("capability_escalated", _ESCALATED.replace("@SEP@", " ") + """
  SELECT scan_id, name AS target, added FROM escalated WHERE added <> ''""")
def capability_escalated(spark, sf):
    changes = drift.tool_diff(*B.versions(spark, sf), texts=False)
    return (changes.where((F.col("kind") == "tool_schema_changed") & (F.size("added_classes") > 0))
            .select("scan_id", "target", F.col("added_classes").alias("added")))


def _drift_sql() -> str:
    place = {k: str(i) for i, k in enumerate(C.CHANGE_KINDS)}
    described, schema = place["tool_description_changed"], place["tool_schema_changed"]
    both = "old IS NOT NULL AND new IS NOT NULL AND old <> new"
    steered = _gained(C.STEERING_FINDING)
    rows = [
        ("instruction_added", described, ("name",), f"pairs WHERE {both} AND {steered}", "name"),
        ("description_shortened", described, ("name",),
         f"pairs WHERE {both} AND NOT {steered} AND strlen(new) < strlen(old)", "name"),
        ("description_changed", described, ("name",),
         f"pairs WHERE {both} AND NOT {steered} AND strlen(new) >= strlen(old)", "name"),
        ("capability_escalated", schema, ("name", "added"), "escalated WHERE added <> ''", "name"),
        ("schema_changed", schema, ("name",), "escalated WHERE added = ''", "name"),
        ("server_version_changed", place["server_version_changed"], ("before", "after"), "version_changes", "target"),
    ]
    for kind in C.CHANGE_KINDS:
        if kind not in ("tool_description_changed", "tool_schema_changed", "server_version_changed"):
            rows.append((kind, place[kind], ("target",), f"changes WHERE kind = '{kind}'", "target"))
    return _ESCALATED.replace("@SEP@", ", ") + " UNION ALL ".join(
        f"SELECT scan_id, {K.finding('drift.' + rule, seq, detail=detail, tool=tool)} FROM {source}"
        for rule, seq, detail, source, tool in rows)


@query("drift_findings", _drift_sql())
def drift_findings(spark, sf):
    return shown(drift.drift_findings(drift.manifest_diff(*versions_of(spark, sf), texts=False)))


_EVENT_SEVERITY = f"""CASE kind WHEN 'tool_description_changed' THEN
    CASE WHEN {_gained(C.STEERING_EVENT, 'before', 'after')} THEN 'critical'
         WHEN strlen(after) < strlen(before) THEN 'info' ELSE 'low' END
  WHEN 'tool_added' THEN 'medium' WHEN 'tool_schema_changed' THEN 'low' WHEN 'resource_added' THEN 'low'
  WHEN 'prompt_added' THEN 'low' ELSE 'info' END"""


@query("drift_event_severity", f"WITH {K.CHANGES} SELECT scan_id, kind, target, {_EVENT_SEVERITY} AS severity FROM changes")
def drift_event_severity(spark, sf):
    changes = drift.manifest_diff(*versions_of(spark, sf), texts=False)
    return changes.select("scan_id", "kind", "target", drift.drift_event_severity(
        F.col("kind"), F.col("event_steered"), F.col("shorter")).alias("severity"))


#: Each document is one capture of its source; its tools are the document and one shared tool.
HISTORY = f"""
  WITH scans AS (SELECT doc_id AS id, source, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id // 3 AS INT)) AS seen FROM documents),
  pairs AS (SELECT id, source, seen, lag(id) OVER (PARTITION BY source ORDER BY seen, id) AS prev FROM scans),
  tools AS (SELECT doc_id AS id, 'shared' AS name, nfc_normalize(text || {B.PHRASE_CASE}) AS text FROM documents
    UNION ALL SELECT doc_id, lang, lang FROM documents),
  was AS (SELECT p.id, t.name, t.text FROM pairs p JOIN tools t ON t.id = p.prev),
  now AS (SELECT p.id, t.name, t.text FROM pairs p JOIN tools t ON t.id = p.id WHERE p.prev IS NOT NULL),
  joined AS (SELECT coalesce(w.id, n.id) AS id, coalesce(w.name, n.name) AS target, w.text AS before, n.text AS after
    FROM was w FULL JOIN now n ON w.id = n.id AND w.name = n.name),
  changes AS (SELECT id, 'tool_added' AS kind, target, '' AS before, after FROM joined WHERE before IS NULL
    UNION ALL SELECT id, 'tool_removed', target, '', '' FROM joined WHERE after IS NULL
    UNION ALL SELECT id, 'tool_description_changed', target, before, after FROM joined WHERE before <> after)"""


def history(spark, sf):
    docs = B.table(spark, sf, "documents")
    scans = docs.selectExpr("doc_id AS id", "xxhash64(source) AS server_id", "source",
                            "timestamp_seconds(1704067200 + (doc_id - doc_id % 3) * 1200) AS scanned_at")
    shared = docs.selectExpr("doc_id AS scan_id", "0 AS pos", "'shared' AS name",
                             f"concat(text, {B.PHRASE_CASE}) AS description", "CAST(NULL AS STRING) AS input_schema")
    other = docs.selectExpr("doc_id AS scan_id", "1 AS pos", "lang AS name", "lang AS description",
                            "CAST(NULL AS STRING) AS input_schema")
    return scans, shared.unionByName(other)


@query("drift_events", HISTORY + f""" SELECT p.prev AS from_scan_id, p.id AS to_scan_id, kind, target,
  {_EVENT_SEVERITY} AS severity, epoch_us(p.seen) AS detected_at, length(before) AS before_chars, length(after) AS after_chars
  FROM changes c JOIN pairs p ON p.id = c.id""")
def drift_events(spark, sf):
    scans, tools = history(spark, sf)
    text = lambda k: F.coalesce(F.char_length(F.get_json_object("diff_json", f"$.{k}")), F.lit(0)).alias(f"{k}_chars")
    return drift.drift_events(scans, {"tools": tools}).select(
        "from_scan_id", "to_scan_id", "kind", "target", "severity", "detected_at", text("before"), text("after"))
