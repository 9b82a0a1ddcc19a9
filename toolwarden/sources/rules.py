"""Injection rule sets from files."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .. import constants as C
from ..functions.regex import check_patterns


@dataclass(frozen=True)
class RuleSet:
    version: int
    rules: tuple[dict, ...]


DEFAULT_RULES = RuleSet(1, C.INJECTION_RULES)


def _decode(text: str, path: str) -> dict:
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as err:
            raise RuntimeError("YAML rule files need PyYAML; use JSON instead") from err
        return yaml.safe_load(text) or {}
    return json.loads(text)


def parse_rules(spark: SparkSession, document: dict) -> RuleSet:
    """Check a rule document; every problem stops the run before any scan.

    A severity must be given; one that is not known reads as info.
    """
    rules = []
    for raw in document.get("rules") or ():
        rule = {key: raw.get(key) or "" for key in ("id", "severity", "title", "detail", "remediation")}
        if not rule["severity"]:
            raise ValueError(f"rule {rule['id']!r}: missing severity")
        rule["any"] = tuple(raw.get("any") or ())
        rules.append(rule)
    check_patterns(spark, [p for rule in rules for p in rule["any"]])
    return RuleSet(int(document.get("version") or 0), tuple(rules))


def read_rules(spark: SparkSession, path: str) -> RuleSet:
    """A rule set from a JSON or YAML file, read through Spark so any file system works."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None:
        raise FileNotFoundError(path)
    return parse_rules(spark, _decode(text.value, path))
