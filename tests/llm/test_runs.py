import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

from toolwarden.llm import run_queries, runs

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(words, least=6, periods=4):
    """Every period from 1 up, every stretch; of equal or inner stretches the smallest period stays."""
    out = []
    for q in range(1, len(words) // periods + 1):
        t = q
        while t < len(words):
            end = t
            while end < len(words) and words[end] == words[end - q]:
                end += 1
            start, length = t - q, end - t + q
            if length >= max(least, periods * q) and not any(
                    s <= start and s + n >= start + length for s, n, _ in out):
                out.append((start, length, q))
            t = max(end, t + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def looping(rng):
    n, k = rng.choice([0, 1, 5, 6, 7, 20, 60, 200]), rng.choice([1, 2, 3, 10])
    words = [rng.choice("abcdefghij"[:k]) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n > 8 else 0):
        a, q = rng.randrange(n), rng.randint(1, n // 5)
        for i in range(q, min(n - a, q * rng.randint(2, 8) + rng.randint(0, q))):
            words[a + i] = words[a + i - q]
    return words


def test_runs_against_every_period(monkeypatch):
    rng = random.Random(5)
    for trial in range(250):
        texts, periods, least = [looping(rng) for _ in range(rng.randint(1, 6))], rng.choice([3, 4, 5]), rng.choice([3, 6, 20])
        monkeypatch.setattr(runs, "CELLS", rng.choice([1, 64, 1 << 18]))
        got = runs._found(pa.array([" ".join(t) for t in texts]), least, periods).to_pylist()
        for words, row in zip(texts, got):
            want = brute(words, least, periods)
            assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == want
            assert row["collapsed"] == collapsed(words, want) and row["n_words"] == len(words)


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_texts_of_many_squares():
    """Fibonacci and doubling texts hold more squares than any others; one word is a run at every level."""
    doubling = [("a", "b")[bin(i).count("1") % 2] for i in range(4096)]
    for words in (fibonacci(1500), doubling[:1200], ["x"] * 1000, (["x"] * 40 + ["y"]) * 12, ["x", "y", "x", "z"] * 100):
        got = runs._found(pa.array([" ".join(words)]), 6, 4).to_pylist()[0]
        assert [(r["start"], r["length"], r["period"]) for r in got["runs"]] == brute(words)
    assert runs._found(pa.array([" ".join(doubling)]), 6, 4).to_pylist()[0]["runs"] == []


def test_a_very_long_text_beside_others(monkeypatch):
    rng = random.Random(1)
    head = [f"w{rng.randint(0, 5000)}" for _ in range(150000)]
    words = head + (head[:20011] * 5)[:90001] + ["end"]
    got = runs._found(pa.array(["x " * 7, " ".join(words), None, "y"]), 6, 4).to_pylist()
    assert got[0]["runs"] == [{"start": 0, "length": 7, "period": 1}] and got[0]["collapsed"] == "x"
    assert got[1]["runs"] == [{"start": 150000, "length": 90001, "period": 20011}]
    assert got[1]["collapsed"].split() == head + head[:20011] + ["end"] and got[1]["n_words"] == 240002
    assert got[2] == {"n_words": 0, "runs": [], "collapsed": ""} and got[3]["collapsed"] == "y"


def test_whole_rows(docs_df):
    rows = [(1, "a\tb \n a b\x0ba b a b a"), (None, None), (1, "a\tb \n a b\x0ba b a b a"), (2, ""), (3, " \n"), (4, "é é é é é é É")]
    docs = docs_df(rows).selectExpr("*", "'x' AS runs", "1 AS _text")
    got = runs.with_runs(docs.repartition(3))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_text", "n_words", "runs", "collapsed"]
    found = {(r.doc_id, r.text): (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()}
    assert got.count() == 6
    assert found[1, rows[0][1]] == (9, [(0, 9, 2)], "a b") and found[4, rows[5][1]] == (7, [(0, 6, 1)], "é É")
    assert found[None, None] == found[2, ""] == found[3, " \n"] == (0, [], "")
    assert runs.with_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.with_runs(docs, periods=2)


def test_the_query_on_a_small_table(spark, docs_df, tmp_path):
    rng = random.Random(7)
    rows = [(i, " \n".join(looping(rng) if i % 2 else [f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 90))])) for i in range(300)]
    rows += [(None, "a a a a a a a"), (0, None), (5, rows[5][1])]
    docs_df(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = run_queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for i, text in rows:
        words, h = WORD.findall(text or ""), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        found = brute(words)
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(found), *top, top[0] if top[0] is None else 1000 * top[1] // top[2],
                     digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(collapsed(words, found))))
    key = lambda r: [(x is not None, x) for x in r]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
