"""Findings as reports: result rows, rule catalogue, tables, documents."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.detect import escape_controls, is_hostile
from ..functions.jsontext import json_quote
from ..functions.scales import severity_rank
from ..sources.documents import element, fixed, piece, write_document
from .capability import capability_summary
from .cost import model_costs
from .findings import listing_order
from .scoring import deductions


def sarif_level(severity: Column) -> Column:
    return (F.when(severity.isin("critical", "high"), F.lit("error"))
            .when(severity == "medium", F.lit("warning")).otherwise(F.lit("note")))


def _filled(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def sarif_results(findings: DataFrame, targets: DataFrame) -> DataFrame:
    """One result row per finding; ``targets`` has (scan_id, target)."""
    detail, fix, tool, target = _filled("detail"), _filled("remediation"), _filled("tool"), _filled("target")
    message = F.concat("title", F.when(detail != "", F.concat(F.lit(". "), detail)).otherwise(F.lit("")),
                       F.when(fix != "", F.concat(F.lit(" Fix: "), fix)).otherwise(F.lit("")))
    return findings.join(targets.select("scan_id", "target"), "scan_id", "left").select(
        "scan_id", "analyzer_ord", "seq", "rule_id", sarif_level(F.col("severity")).alias("level"),
        message.alias("message"),
        F.when(target != "", F.concat(F.lit("mcp-server/"), target)).otherwise(F.lit("mcp-server")).alias("uri"),
        F.concat(target, F.when(tool != "", F.concat(F.lit("/"), tool)).otherwise(F.lit(""))).alias("logical_name"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Distinct rules by id; title and level of the first finding in report order."""
    first = F.min(F.struct(F.col("scan_id"), listing_order().alias("o"),
                           F.struct("title", "severity").alias("f"))).getField("f")
    return (findings.groupBy("rule_id").agg(first.alias("f"))
            .select("rule_id", F.col("f.title").alias("title"),
                    sarif_level(F.col("f.severity")).alias("level")).orderBy("rule_id"))


def findings_table(findings: DataFrame) -> DataFrame:
    """Findings of every scan, worst first, equal severities in listing order."""
    return (findings.withColumn("severity_rank", severity_rank(F.col("severity")))
            .orderBy("scan_id", F.desc("severity_rank"), "analyzer_ord", "seq", "tool", "title"))


def grade_notes(findings: DataFrame, scorecards: DataFrame) -> DataFrame:
    """Headline per scan with the note that qualifies its grade."""
    unseen = (findings.where(F.col("rule_id") == "capability.not_observed")
              .select("scan_id").distinct().withColumn("unseen", F.lit(True)))
    note = F.concat(
        F.when(F.col("capped"), F.lit(", capped by a critical finding")).otherwise(F.lit("")),
        F.when(F.col("unseen"), F.lit(", behavior not observed")).otherwise(F.lit("")))
    return scorecards.join(unseen, "scan_id", "left").select("scan_id", "score", "grade", note.alias("note"))


#: Order of the pieces of all reports: by scan, then place in the report, then the section's own order.
REPORT_ORDER = ["scan_id", "place", "a", "b", "c", "d"]
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}


def _json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns), _TIMES)


def _members(*columns: Column | str) -> Column:
    """The members of a JSON object without its braces."""
    text = _json(*columns)
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _report_rows(rows: DataFrame, place: int, columns: list[Column], a=None, b=None, c=None, d=None) -> DataFrame:
    whole = lambda x, n: (F.lit(0) if x is None else x).cast("bigint").alias(n)
    return rows.select("scan_id", F.lit(place).alias("place"), whole(a, "a"), whole(b, "b"), whole(c, "c"),
                       (F.lit("") if d is None else d).alias("d"), *columns)


def report_pieces(headers: DataFrame, scorecards: DataFrame, findings: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """The reports of all scans as pieces of a document, one row per piece, in ``REPORT_ORDER``.

    ``headers`` has scan_id and, as far as they are known, target (a struct or a name), server_name,
    server_version, protocol_version, manifest_hash, runner, baseline_state, tool_version,
    scanned_at and duration_ms.  ``facts`` are the tools with tokens and classes.  Every tool, finding
    and deduction is a row of its own: nothing is gathered, whatever one server lists.
    """
    given = headers.columns

    def known(name: str, kind: str = "string") -> Column:
        return (F.coalesce(F.col(name), F.lit("" if kind == "string" else 0)) if name in given
                else F.lit("" if kind == "string" else 0)).cast(kind).alias(name)

    none = findings.sparkSession.createDataFrame([], "scan_id bigint, pos int, name string, token_base bigint, tokens bigint, classes array<string>")
    tools = none if facts is None else facts
    costs = model_costs(tools).select("scan_id", "tool_count", "models")
    classes = capability_summary(tools).select("scan_id", F.col("classes").alias("_classes"))
    wide = (headers.join(scorecards, "scan_id").join(costs, "scan_id", "left").join(classes, "scan_id", "left")
            .withColumn("tool_count", F.coalesce("tool_count", F.lit(0))))
    empty = F.array().cast("array<string>")
    target = F.col("target") if "target" in given else F.lit("")
    if "target" in given and not headers.schema["target"].dataType.typeName() == "struct":
        target = F.struct(F.coalesce(F.col("target"), F.lit("")).alias("name"))
    elif "target" not in given:
        target = F.struct(F.lit("").alias("name"))
    server = F.struct(known("server_name").alias("name"), known("server_version").alias("version"), known("protocol_version"))
    models = F.coalesce("models", F.array().cast(costs.schema["models"].dataType))
    opening = F.concat(
        F.lit("{"), _members(F.col("scan_id"), target.alias("target"), server.alias("server"), known("manifest_hash"), known("runner")),
        F.lit(',"context_cost":{'), _members(F.col("tool_count"), models.alias("models")), F.lit(',"per_tool":['))
    counts = F.struct("critical", "high", "medium", "low", "info")
    closing = F.concat(
        F.lit("],"), _members(counts.alias("count_by_severity"), F.when(F.col("capped"), F.lit(True)).alias("capped")), F.lit("},"),
        _members(known("baseline_state"), known("tool_version"), F.lit(C.RUBRIC_VERSION).alias("rubric_version"),
                 *([F.col("scanned_at")] if "scanned_at" in given else []), known("duration_ms", "bigint")), F.lit("}"))
    by_name = tools.groupBy("scan_id", "name").agg(F.max_by("classes", "pos").alias("classes")).where(F.size("classes") > 0)
    member = lambda key, value: F.concat(json_quote(key), F.lit(":"), F.to_json(value))
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    listed = listing_order()
    # A finding's meta is JSON text already and goes in as it is, on one line.
    fine = F.translate("meta", "\n\r", "  ")
    bodied = F.concat(F.lit("{"), _members("analyzer", "rule_id", "severity", "title", blank("detail"), blank("tool"), blank("remediation")),
                      F.when(fine.isNotNull() & (fine != ""), F.concat(F.lit(',"meta":'), fine)).otherwise(F.lit("")), F.lit("}"))
    taken = deductions(findings).withColumn("_l", F.col("listing"))
    parts = [
        _report_rows(wide, 0, piece(opening, starts=True)),
        _report_rows(tools, 1, element(_json(F.col("name"), F.col("tokens"))), -F.col("tokens"), F.col("pos")),
        _report_rows(wide, 2, piece(F.concat(F.lit(']},"capabilities":{"classes":'), F.to_json(F.coalesce("_classes", empty)), F.lit(',"by_tool":{')))),
        _report_rows(by_name, 3, element(member(F.col("name"), F.col("classes"))), d=F.col("name")),
        _report_rows(wide, 4, piece('}},"findings":[')),
        _report_rows(findings, 5, element(bodied), listed["analyzer_ord"], listed["seq"], d=F.concat(listed["t"], F.lit(" "), listed["title"])),
        _report_rows(wide, 6, piece(F.concat(F.lit('],"score":{'), _members("score", "grade", "rubric_version"), F.lit(',"deductions":[')))),
        _report_rows(taken, 7, element(_json("rule_id", blank("tool"), "severity", "points")), -F.col("points"), F.col("_l.analyzer_ord"),
                     F.col("_l.seq"), F.concat("tool", F.lit(" "), "rule_id")),
        _report_rows(wide, 8, piece(closing, ends=True)),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_reports(pieces: DataFrame, path: str) -> None:
    """All reports as one JSON array."""
    ends = fixed(pieces.sparkSession, {-1: "[", 99: "]"})
    ends = ends.select(F.when(F.col("place") < 0, -(1 << 62)).otherwise(1 << 62).cast("bigint").alias("scan_id"), "place",
                       *[F.lit(0).cast("bigint").alias(c) for c in "abc"], F.lit("").alias("d"), "text", "starts", "ends")
    write_document(pieces.unionByName(ends), path, REPORT_ORDER)


def sarif_document(results: DataFrame, rules: DataFrame, path: str, tool: str, version: str, uri: str = "", help_uri: str = "") -> None:
    """One SARIF 2.1.0 file with one run: the rules by id, then all results in listing order."""
    spark = results.sparkSession
    text = lambda c: F.struct(F.col(c).alias("text"))
    rule = _json(F.col("rule_id").alias("id"), F.col("rule_id").alias("name"), text("title").alias("shortDescription"),
                 F.nullif(F.lit(help_uri), F.lit("")).alias("helpUri"), F.struct("level").alias("defaultConfiguration"))
    place = F.struct(F.struct(F.struct("uri").alias("artifactLocation")).alias("physicalLocation"),
                     F.array(F.struct(F.col("logical_name").alias("name"), F.lit("member").alias("kind"))).alias("logicalLocations"))
    result = _json(F.col("rule_id").alias("ruleId"), F.col("level"), text("message").alias("message"), F.array(place).alias("locations"))
    driver = json.dumps({"name": tool, **({"informationUri": uri} if uri else {}), "version": version}, ensure_ascii=False)
    head = ('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":'
            + driver[:-1] + ',"rules":[')
    order = ["place", "scan_id", "analyzer_ord", "seq", "name"]
    zero = lambda n, kind: F.lit(0).cast(kind).alias(n)
    numbers = [zero("scan_id", "bigint"), zero("analyzer_ord", "int"), zero("seq", "bigint")]
    pieces = (fixed(spark, {0: head, 2: ']}},"results":[', 4: "]}]}"}).select("place", *numbers, F.lit("").alias("name"), "text", "starts", "ends")
              .unionByName(rules.select(F.lit(1).alias("place"), *numbers, F.col("rule_id").alias("name"), *element(rule)))
              .unionByName(results.select(F.lit(3).alias("place"), "scan_id", "analyzer_ord", "seq", F.col("rule_id").alias("name"), *element(result))))
    write_document(pieces, path, order)


def text_hygiene(texts: DataFrame, column: str, keep_lines: bool = False) -> DataFrame:
    """Add ``hostile`` and ``safe_text``: text a terminal would obey, and its visible form.

    The column may be binary: bytes as a server sent them, before anything replaced broken ones.
    """
    text = F.col(column)
    return (texts.withColumn("hostile", is_hostile(text, keep_lines))
            .withColumn("safe_text", escape_controls(text, keep_lines)))
