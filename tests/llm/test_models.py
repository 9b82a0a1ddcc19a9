import math
import zlib
from collections import Counter

from toolwarden.llm import language_model, quality, urls

from . import brute


def in_fold(i, fold):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == fold


def test_base_scores(docs_df, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % (k + 3)}" for k in range(1, 30 + i % 7))) for i in range(80)]
    rows += [(200, None), (201, ""), (None, "W1 w2 unseen"), (202, "only here " * 3), (202, "only here " * 3)]
    counts = Counter()
    tokens = lambda t: [*brute.words(t), None]
    for i, t in rows:
        if not in_fold(i, 1):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    for frequent in (1 << 20, 5):  # the table holds all tokens, or next to none
        monkeypatch.setattr(language_model, "FREQUENT", frequent)
        got = language_model.lm_scores(docs_df(rows).repartition(2)).collect()
        assert len(got) == len(rows)
        texts = dict(rows)
        for r in got:
            own = tokens(texts[r.doc_id])
            base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[t] > 0 for t in own), n)
            assert abs(r.base_score - base) < 1e-6 and r.score <= 0 and r.held_out == in_fold(r.doc_id, 1)
    assert language_model.lm_scores(docs_df([])).count() == 0


def test_filter_never_forgets():
    import numpy as np

    rng = np.random.default_rng(3)
    value = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)) & language_model._LOW  # all in segment 0
    count = rng.geometric(0.3, len(value))
    bits = language_model._segment_bits(value, count, 1 << 20)
    first = np.zeros(language_model.SEGMENTS + 1, np.int64)
    first[1:] = len(bits) * 8
    got = language_model.read_counts(value, first, bits)
    level = np.floor(np.log2(count)) + 1
    assert (got >= (np.exp2(level - 1) + np.exp2(level) - 1) / 2).all()
    assert (got > np.exp2(level)).mean() < 0.05
    other = rng.integers(0, 1 << 40, 5000, dtype=np.uint64)
    assert (language_model.read_counts(other, first, bits) > 0).mean() < 0.05


def test_small_broadcasts_change_no_score(table_df):
    """What the broadcast part of the filter leaves out is answered by the segments that own it."""
    docs = table_df("documents").repartition(3)
    whole = {r.doc_id: r for r in language_model.lm_scores(docs).collect()}
    none = {r.doc_id: r for r in language_model.lm_scores(docs, filter_bits=0).collect()}
    assert len(none) == len(whole) and all(abs(none[i].score - r.score) < 1e-9 for i, r in whole.items())
    assert all(none[i][:6] == r[:6] or abs(none[i].base_score - r.base_score) < 1e-9 for i, r in whole.items())
    # In part: both filters err on their own, more often in segments as small as these, but not to one side.
    part = {r.doc_id: r.score for r in language_model.lm_scores(docs, filter_bits=language_model.SEGMENTS * 256).collect()}
    assert abs(sum(part.values()) / sum(r.score for r in whole.values()) - 1) < 0.01


def test_model_beats_the_base(table_df):
    got = language_model.lm_scores(table_df("documents")).where("held_out").groupBy().sum("score", "base_score").first()
    assert got[0] > got[1]


def test_held_out_accuracy(table_df):
    docs, labels = table_df("documents"), table_df("labels")
    scores = quality.quality_scores(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    own = [r for r in scores if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in own) >= 0.85 * len(own)
    assert all(r.held_out == in_fold(r.doc_id, 0) and r.predicted == (r.score >= 0.3) for r in scores)


def test_quality_edges(spark, docs_df):
    rows = docs_df([(1, None), (None, "a"), (2, ""), (2, "x " * 40_000)])
    none = spark.createDataFrame([(1, None)], "doc_id bigint, quality int")
    assert [r.score for r in quality.quality_scores(rows, none).collect()] == [0.5] * 4
    assert quality.accepted(rows.withColumnRenamed("lang", "_score"), none).columns == ["doc_id", "text", "_score", "source", "n_chars"]
    assert quality.quality_scores(docs_df([]), none).count() == 0


RULES = [("allow", "com/"), ("block", "bad.com/"), ("allow", "bad.com/ok/"), ("block", "net/")]


def test_urls(spark):
    rows = [(1, "HTTP://WWW.X.com/a?b#c"), (2, "http://bad.com"), (3, "http://a.bad.com/x"), (4, "https://notbad.com/OK/"),
            (5, "http://bad.com/ok/1#?"), (6, "//x.com/"), (7, None), (8, "http://"), (None, "ftp://é.net/é?q"), (9, "x://bad.com?/ok/"),
            (9, "x://bad.com?/ok/"), (10, "http://q.org/" + "long/" * 3000)]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id bigint, url string, html string, rule string")
    got = sorted(((r.page_id, r.host, r.path[:12], r.rule) for r in urls.judge(df, RULES).collect()), key=str)
    want = [(1, "www.x.com", "/a", "com/"), (2, "bad.com", "", "com/"), (3, "a.bad.com", "/x", "bad.com/"),
            (4, "notbad.com", "/OK/", "com/"), (5, "bad.com", "/ok/1", "bad.com/ok/"), (6, "", "", None), (7, "", "", None),
            (8, "", "", None), (None, "é.net", "/é", "net/"), (9, "bad.com", "", "com/"), (9, "bad.com", "", "com/"),
            (10, "q.org", "/long/long/l", None)]
    want = [(i, h, p, None if (p == "" and r) else r) for i, h, p, r in want]
    assert got == sorted(want, key=str)
    assert urls.judge(df.limit(0), RULES).count() == 0
