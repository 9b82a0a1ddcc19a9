import math
import random

import numpy as np

from toolwarden.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, queries, k):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, x in fine:
        if q in queries:
            found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in fine if i != q and len(x) == len(y))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])}
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [round(rng.uniform(-2, 2), 1) for _ in range(6)]) for i in range(300)]
    rows += [(900 + i, [0.5] * 6) for i in range(20)] + [(1000, [40.0, -1e4, 0.0, 3.0, 1.0, 2.0]), (1001, [1.0, 2.0])]
    rows += [(1002, None), (1003, [None] * 6), (1004, [float("nan")] * 6), (1005, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    queries = {0, 7, 900, 1000, 1001, 1002, 1004}
    got = topk.top_k(df, df.where(df.vec_id.isin(*queries)), 5, 256, query_rows=3, block_rows=64)
    assert {tuple(r) for r in got.collect()} == brute(rows, queries, 5)


def test_signed_digits():
    for q in [*range(-300, 300), 12345, -99999]:
        digits = topk._digits(q)
        assert sum(d << p for p, d in digits) == q
        assert all(b - a > 1 for (a, _), (b, _) in zip(digits, digits[1:]))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(df, df).count() == 0
