"""Physical plans: pruned scans, no unbounded single-task work.  Cross joins are looked for where the queries run."""

import re

from toolwarden.plans.catalog import CHECKS, QUERIES

from .conftest import DATA

def plan(spark, name):
    df = QUERIES[name](spark, DATA)
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_are_pruned(spark):
    text = plan(spark, "model_cost")
    for schema in re.findall(r"ReadSchema: (\S+)", text):
        assert "lang" not in schema and "n_chars" not in schema
    assert "text" not in "".join(re.findall(r"ReadSchema: (\S+)", plan(spark, "version_changed")))


def test_no_python_where_builtins_do(spark):
    for name in ("rule_findings", "model_cost", "score", "list_latest", "typosquat", "trace_behavior"):
        assert "Python" not in plan(spark, name), name


def scans(spark, name, folder=DATA):
    """How often the executed plan of a query, and of what it stores on the way, reads each given table."""
    import collections

    found = collections.Counter()
    df = QUERIES[name](spark, DATA)
    df.write.format("noop").mode("overwrite").save()
    text = df._jdf.queryExecution().executedPlan().toString()
    for path in re.findall(r"InMemoryFileIndex\(\d+ paths?\)\[file:([^\],]*)", text):
        if path.startswith(folder):
            found[path.rsplit("/", 1)[-1].removesuffix(".parquet")] += 1
    return found


def test_what_is_stored_is_read_once(spark):
    assert scans(spark, "per_tool_tokens")["conversations"] == 0  # the counts are stored; ranking reads only these
    assert set(scans(spark, "snapshot")) <= {"events", "customer"} and scans(spark, "snapshot")["customer"] <= 1


def test_analyzers_read_stored_facts(spark):
    """The texts are searched once for all analyzers, not once for each."""
    for name in ("scan_report_counts", "findings_union"):
        text = plan(spark, name)
        assert "tool-facts" in text and "oversized" in text and "disregard" not in text.split("drift.")[0], name
    assert scans(spark, "scan_report_counts")["documents"] == 0


def test_texts_move_after_changes_are_known(spark):
    """No exchange of a diff of hashes has a text column before the join that fetches texts."""
    from toolwarden.operators import drift
    from toolwarden.plans import bridge

    base, cur = bridge.versions(spark, DATA)
    plan = drift.changed_tools(drift.tool_keys(base), drift.tool_keys(cur, 1))._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.split("Join")[1]
    above = joined.split("Aggregate")[0]
    assert "description" not in above and "input_schema" not in above


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_costly_columns_are_found_once(spark):
    """A filter on what a projection finds would make it find it again below."""
    words = plan(spark, "capability_by_tool")
    assert words.count("mkdir") == 3  # the tests of one class: stems, whole words, the folding form
    assert plan(spark, "typosquat").count("levenshtein(") == 1


def test_latest_scans_meet_one_table_of_sums(spark):
    """Each sort or hash table of a join stage takes memory of its own; findings and tools are summed together."""
    text = plan(spark, "list_latest")
    assert len(re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) ", text)) == 2 and "LeftSemi" not in text
