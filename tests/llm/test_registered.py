"""The registered queries: against their SQL, and the pipeline from end to end."""

import corpus_pipeline
import pytest

import __spark_entry__ as entry

from ..conftest import DATA
from ..test_queries import con, rows  # noqa: F401
from . import brute


@pytest.mark.parametrize("name", sorted(entry.llm.CHECKS))
def test_sql(spark, con, name):  # noqa: F811
    df = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


def test_names():
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in entry.queries()}
    assert "pipeline" in entry.queries()


def test_pipeline(spark):
    """Each stage on its own input: what it keeps, and that columns stay as they are."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.kept(stage(spark, docs, DATA), f"test-{name}")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name != "sentencepiece":
            assert docs.columns == columns
        if name != "line_dedup":
            assert all(before[i] == t for i, t in after.items())
        seen[name] = before, after
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    before, after = seen["quality"]
    right = [(i in after) == (labels[i] == 1) for i in before if i in labels]
    assert sum(right) >= 0.9 * len(right)
    before, after = seen["line_dedup"]
    assert set(before) == set(after) and sum(before[i] != after[i] for i in before) > 0
    before, after = seen["near_duplicates"]
    want = brute.jaccard(list(before.items()))
    assert set(after) == {i for i, (n, c) in want.items() if c == i or not n}
    before, after = seen["decontamination"]
    items = [" ".join(brute.words(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(f" {x} " in f" {' '.join(brute.words(t))} " for t in after.values() for x in items)
    before, after = seen["sentencepiece"]
    assert set(before) == set(after) and docs.where("NOT exact OR n_pieces <> size(pieces)").count() == 0
