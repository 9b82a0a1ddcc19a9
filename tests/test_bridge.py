"""Model tables derived from the given ones."""

from toolwarden.operators import drift
from toolwarden.plans import bridge


def test_header_of_a_scan_without_its_first_document(spark, tmp_path):
    rows = [(4, "a"), (5, "b"), (9, "c"), (10, "d"), (15, "e")]
    docs = spark.createDataFrame([(i, "text", "en", s) for i, s in rows], "doc_id bigint, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    old, new = bridge.listings(spark, str(tmp_path))["servers"]
    get = lambda side: {r.scan_id: (r.server_name, r.server_version) for r in side.collect()}
    assert get(old) == {4: ("a", "1.1"), 8: ("c", "1.0"), 12: ("e", "1.0")}
    assert get(new) == {4: ("a", "1.0"), 8: ("c", "1.1"), 12: ("e", "1.1")}
    assert {r.scan_id for r in drift.version_changed(old, new).collect()} == {4, 8, 12}
