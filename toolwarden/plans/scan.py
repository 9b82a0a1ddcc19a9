"""The scan plan: from captured tables to findings, costs and scorecards."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import capability, cost, drift, injection, posture, scoring, supply
from ..operators.findings import findings_union, rows_of
from ..session import stored

#: An extra analyzer: takes the inputs of a scan, returns rows of the findings table.
Analyzer = Callable[["ScanInputs"], DataFrame]


@dataclass
class ScanInputs:
    """Tables of one run.  Only ``tools`` is required; absent parts skip their checks."""

    tools: DataFrame
    scans: DataFrame | None = None
    specs: DataFrame | None = None
    packages: DataFrame | None = None
    advisories: DataFrame | None = None
    endpoints: DataFrame | None = None
    traces: DataFrame | None = None
    baseline: dict[str, DataFrame] | None = None
    current: dict[str, DataFrame] | None = None
    rules: tuple = C.INJECTION_RULES
    popular: tuple = C.POPULAR_PACKAGES
    as_of: Column | None = None
    extra: tuple[Analyzer, ...] = ()
    #: Intervals of affected versions (``packages.advisory_ranges``), beside the versions that ``advisories`` lists.
    advisory_ranges: DataFrame | None = None


def tool_facts(tools: DataFrame, rules=C.INJECTION_RULES) -> DataFrame:
    """Everything later steps need to know about each tool, in one pass over the texts.

    The result is narrow (no descriptions or schemas), so it can be persisted or
    written once and read by every analyzer: (scan_id, pos, name, token_base, tokens,
    classes, hits), where ``hits`` holds one finding or NULL per check.
    """
    rows = injection.with_signs(cost.schema_depth(cost.tool_tokens(capability.classify_tools(
        injection.with_text(capability.with_properties(tools))))))
    hits = F.array(
        cost.bloat_hit(), *capability.declared_hits(), *injection.rule_hits(rules), *injection.structural_hits())
    return rows.select("scan_id", "pos", "name", "token_base", "tokens", "classes", hits.alias("hits"))


def facts_findings(facts: DataFrame) -> DataFrame:
    """The per-tool findings held in ``tool_facts``."""
    return rows_of(facts, F.col("hits"))


def scan_findings(inputs: ScanInputs, facts: DataFrame | None = None) -> DataFrame:
    """Findings of all analyzers that have inputs.

    Several analyzers read the facts: without any given, they are worked out once and stored, as they are narrow.
    """
    facts = stored(tool_facts(inputs.tools, inputs.rules), "tool-facts") if facts is None else facts
    parts = [facts_findings(facts), cost.oversized_tool(facts)]
    if inputs.traces is not None:
        parts += [capability.not_observed(inputs.traces), capability.observed_decoy_read(inputs.traces),
                  capability.observed_egress(inputs.traces),
                  capability.declared_observed_gap(inputs.traces, capability.capability_summary(facts))]
    if inputs.specs is not None:
        parts.append(supply.supply_chain(inputs.specs, inputs.packages, inputs.advisories,
                                         F.current_timestamp() if inputs.as_of is None else inputs.as_of,
                                         inputs.popular, inputs.advisory_ranges))
    if inputs.endpoints is not None:
        parts.append(posture.posture_findings(inputs.endpoints))
    if inputs.baseline is not None:
        changes = drift.manifest_diff(inputs.baseline, inputs.current, texts=False)
        parts.append(drift.drift_findings(changes))
    parts += [analyzer(inputs) for analyzer in inputs.extra]
    return findings_union(*parts)


def scan_scorecards(inputs: ScanInputs, facts: DataFrame | None = None) -> DataFrame:
    """Score and grade of every scan.

    Without ``scans``, those are all scans that any input mentions: a server that lists no
    tools is scored too.
    """
    return scoring.scorecards(scan_findings(inputs, facts), scan_ids(inputs, facts))


def scan_ids(inputs: ScanInputs, facts: DataFrame | None = None) -> DataFrame:
    """The scans of a run, each once; read from the narrow tables where there are any."""
    if inputs.scans is not None:
        return inputs.scans
    ids = (inputs.tools if facts is None else facts).select("scan_id")
    more = [inputs.traces, inputs.specs, inputs.endpoints, *(inputs.current or {}).values()]
    for table in more:
        if table is not None and "scan_id" in table.columns:
            ids = ids.unionByName(table.select("scan_id"))
    return ids.distinct()
