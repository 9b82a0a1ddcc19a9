"""Documents written by all tasks: whole, valid, in order."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from toolwarden.operators import findings as findings_ops
from toolwarden.operators import index, injection, report, scoring
from toolwarden.plans import bridge
from toolwarden.plans.scan import ScanInputs, scan_findings, scan_scorecards, tool_facts
from toolwarden.sources import documents

from .conftest import DATA


def test_pieces_in_order_over_any_partitions(spark, tmp_path):
    rng = random.Random(3)
    rows, want = [], []
    for group in range(40):
        rows.append((group, -1, f'{{"g":{group},"x":[', True, False))
        inner = [f"é{k}" for k in range(rng.choice([0, 1, 2, 30]))]
        rows += [(group, k, json.dumps(v, ensure_ascii=False), True, True) for k, v in enumerate(inner)]
        rows.append((group, 99, "]}", False, True))
        want.append({"g": group, "x": inner})
    rows += [(-1, 0, "[", False, False), (99, 0, "]", False, False)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a int, b int, text string, starts boolean, ends boolean")
    for parts, coalesced in ((1, "true"), (7, "true"), (150, "false")):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
        try:
            documents.write_document(df, str(tmp_path / "doc.json"), ["a", "b"])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert json.loads((tmp_path / "doc.json").read_text()) == want
        assert documents.read_lines(spark, str(tmp_path / "doc.json")).count() == len(rows)
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["doc.json"]
    documents.write_document(df.limit(0), f"file://{tmp_path}/none.json", ["a", "b"])
    assert (tmp_path / "none.json").read_text() == ""


def test_a_failed_write_leaves_the_old_document(spark, tmp_path):
    path = str(tmp_path / "doc.json")
    good = spark.createDataFrame([(1, "[]", False, False)], "a int, text string, starts boolean, ends boolean")
    documents.write_document(good, path, ["a"])
    bad = spark.range(100).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.lit("1")).alias("text"),
                                  F.lit(True).alias("starts"), F.lit(True).alias("ends"))
    with pytest.raises(Exception, match="lost"):
        documents.write_document(bad, path, ["id"])
    assert Path(path).read_text() == "[]\n"
    assert not [p for p in tmp_path.iterdir() if ".parts" in p.name]


def test_reports_of_a_whole_scan(spark, tmp_path):
    """Real findings, costs and classes of the smallest tables; each report as the whole of its tables."""
    inputs = ScanInputs(bridge.tools(spark, DATA), endpoints=bridge.endpoints(spark, DATA))
    facts = tool_facts(inputs.tools).persist()
    found, cards = scan_findings(inputs, facts).persist(), scan_scorecards(inputs, facts)
    headers = cards.select("scan_id", F.format_string("srv-%d", "scan_id").alias("target"), F.lit("first_scan").alias("baseline_state"),
                           F.lit("2026-07-01 10:00:00").cast("timestamp").alias("scanned_at"), F.lit("v1").alias("server_version"))
    path = str(tmp_path / "reports.json")
    report.write_reports(report.report_pieces(headers, cards, found, facts), path)
    docs = json.loads(Path(path).read_text())
    assert [d["scan_id"] for d in docs] == sorted(r.scan_id for r in cards.collect())
    by_scan = {d["scan_id"]: d for d in docs}
    for card in cards.collect():
        d = by_scan[card.scan_id]
        assert list(d) == ["scan_id", "target", "server", "manifest_hash", "runner", "context_cost", "capabilities", "findings", "score",
                           "baseline_state", "tool_version", "rubric_version", "scanned_at", "duration_ms"]
        assert (d["score"]["score"], d["score"]["grade"], d["score"].get("capped", False)) == (card.score, card.grade, card.capped)
        assert d["score"]["count_by_severity"]["high"] == card.high and d["target"] == {"name": f"srv-{card.scan_id}"}
        # A score is what its deductions leave, and the findings are those that were counted.
        left = max(100 - sum(x["points"] for x in d["score"]["deductions"]), 0)
        assert card.score == (39 if card.capped else left)
        assert sum(d["score"]["count_by_severity"].values()) == len(d["findings"]) and d["scanned_at"] == "2026-07-01T10:00:00Z"
    listed = {}
    for r in facts.collect():
        listed.setdefault(r.scan_id, []).append(r)
    for scan, tools in listed.items():
        cost, caps = by_scan[scan]["context_cost"], by_scan[scan]["capabilities"]
        tools.sort(key=lambda r: (-r.tokens, r.pos))
        assert cost["per_tool"] == [{"name": r.name, "tokens": r.tokens} for r in tools] and cost["tool_count"] == len(tools)
        assert caps["by_tool"] == {r.name: r.classes for r in sorted(tools, key=lambda r: r.pos) if r.classes}
        assert caps["classes"] == sorted({c for r in tools for c in r.classes}) and len(cost["models"]) > 2
    order = [(f["analyzer"], f["rule_id"], f.get("tool")) for f in by_scan[0]["findings"]]
    want = found.where("scan_id = 0").select("analyzer", "rule_id", "tool", findings_ops.listing_order().alias("o")).orderBy("o").collect()
    assert order == [(r.analyzer, r.rule_id, r.tool) for r in want]
    metas = [f["meta"] for d in docs for f in d["findings"] if "meta" in f]
    assert metas and all(isinstance(m, dict) for m in metas)
    facts.unpersist(), found.unpersist()


def test_one_scan_with_very_many_findings(spark, tmp_path):
    """Two hundred thousand findings of one scan become one valid document; nothing in the plan gathers them."""
    many = spark.range(200000).selectExpr(
        "1L AS scan_id", "'injection' AS analyzer", "2 AS analyzer_ord", "id AS seq", "concat('r', id % 5) AS rule_id", "'low' AS severity",
        "concat('title \"', id, '\"') AS title", "'' AS detail", "concat('t', id % 7) AS tool", "CAST(NULL AS STRING) AS remediation",
        "CAST(NULL AS STRING) AS meta")
    cards = scoring.scorecards(many)
    pieces = report.report_pieces(cards.select("scan_id"), cards, many)
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
    path = str(tmp_path / "reports.json")
    report.write_reports(pieces, path)
    doc = json.loads(Path(path).read_text())[0]
    assert [f["title"] for f in doc["findings"]] == [f'title "{k}"' for k in range(200000)] and len(doc["score"]["deductions"]) == 35


def test_sarif_and_snapshot(spark, tmp_path):
    tools = bridge.tools(spark, DATA)
    found = injection.injection_findings(tools)
    targets = found.select("scan_id", F.format_string("srv-%d", "scan_id").alias("target")).distinct()
    path = str(tmp_path / "out.sarif")
    report.sarif_document(report.sarif_results(found, targets), report.sarif_rules(found), path, "scan", "1.2", "https://x", "https://help")
    doc = json.loads(Path(path).read_text())
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and run["tool"]["driver"]["informationUri"] == "https://x"
    ids = [r["id"] for r in run["tool"]["driver"]["rules"]]
    assert ids == sorted(ids) and {r["ruleId"] for r in run["results"]} == set(ids) and len(run["results"]) == found.count()
    assert run["results"][0]["locations"][0]["logicalLocations"][0]["kind"] == "member"
    empty = str(tmp_path / "empty.sarif")
    report.sarif_document(report.sarif_results(found.limit(0), targets), report.sarif_rules(found.limit(0)), empty, "scan", "1.2")
    assert json.loads(Path(empty).read_text())["runs"][0]["results"] == []

    from toolwarden.plans import index_queries as Q
    summary = Q._summary(spark, DATA)
    servers, events = bridge.index_servers(spark, DATA), bridge.index_events(spark, DATA)
    path = str(tmp_path / "snapshot.json")
    index.snapshot_document(index.snapshot(summary, index.stats(summary, events, Q._as_of()), index.recent_drift(events, servers),
                                           Q._as_of(), "0.1.0"), path)
    doc = json.loads(Path(path).read_text())
    assert list(doc) == ["generated_at", "tool_version", "rubric_version", "stats", "servers", "context_cost_leaderboard", "recent_drift"]
    assert doc["stats"]["total_servers"] == len(doc["servers"]) == sum(doc["stats"]["grade_distribution"].values())
    scores = [(s["score"], s["id"]) for s in doc["servers"]]
    assert scores == sorted(scores) and len(doc["context_cost_leaderboard"]) == 20
    tokens = [s["token_estimate"] for s in doc["context_cost_leaderboard"]]
    assert tokens == sorted(tokens, reverse=True) and len(doc["recent_drift"]) == 50
