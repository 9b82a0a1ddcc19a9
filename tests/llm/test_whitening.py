import numpy as np
import pytest

from toolwarden.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def expected(x, count):
    """Eigenpairs and whitened rows from the whole covariance matrix."""
    y = x - x.mean(0)
    value, vector = np.linalg.eigh(y.T @ y / len(y))
    value, vector = value[::-1][:count], vector[:, ::-1][:, :count]
    return value, y @ vector / np.sqrt(value), value / ((y * y).sum() / len(y))


def test_minres_side_by_side():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((30, 30))
    a, b = a + a.T, rng.standard_normal((30, 4))
    b[:, 2] = 0
    assert np.abs(a @ W.minres(lambda v: a @ v, b, 60, 1e-12) - b).max() < 1e-9


@pytest.mark.parametrize("dims, count, kind", [(64, 32, "flat"), (200, 32, "flat"), (300, 20, "falling"), (120, 32, "equal"),
                                               (10, 32, "flat"), (50, 5, "rank"), (1, 4, "flat"), (40, 6, "hidden")])
def test_jacobi_davidson(dims, count, kind):
    rng = np.random.default_rng(dims)
    turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    value = {"flat": 60 + 5 * rng.random(dims), "falling": 100 * 0.9 ** np.arange(dims), "equal": np.arange(dims) // 4 + 1.0,
             "rank": np.r_[np.full(3, 5.0), np.zeros(max(dims - 3, 0))][:dims], "hidden": np.ones(dims)}[kind]
    if kind == "hidden":  # the leading vector is orthogonal to the start
        start = np.linalg.qr(np.random.default_rng(3).standard_normal((dims, min(dims, count + 8))))[0]
        turn = np.linalg.qr(np.column_stack([rng.standard_normal((dims, 1)) - start @ (start.T @ rng.standard_normal((dims, 1))), turn]))[0]
        value[0] = 9
    matrix = (turn * value) @ turn.T
    matrix = (matrix + matrix.T) / 2
    got = W.jacobi_davidson(lambda v: matrix @ v, dims, count)
    want = np.sort(value)[::-1][:count]
    assert np.abs(got.values - want).max() <= 1e-12 * want[0] and got.residual <= 1e-12 * want[0]
    assert np.abs(got.vectors.T @ got.vectors - np.eye(len(want))).max() < 1e-12


def test_whitening_against_the_whole_matrix(spark, monkeypatch):
    rng = np.random.default_rng(1)
    raw = rng.standard_normal((700, 40)) * np.linspace(3, 0.2, 40) + 1e5
    raw = raw.astype(np.float32)
    rows = [(i, r.tolist(), 0) for i, r in enumerate(raw)]
    odd = [(900, None, 0), (901, [None] + [1.0] * 39, 0), (902, [float("nan")] * 40, 0), (903, [float("inf")] + [1.0] * 39, 0),
           (904, [], 0), (905, [1.0, 2.0], 0), (906, [3e38] * 40, 0)]
    again = [(None, raw[0].tolist(), 0), rows[1], rows[1]]
    monkeypatch.setattr(W, "FAN_IN", 3)  # partial sums meet in several rounds
    df = spark.createDataFrame(rows + odd + again, SCHEMA).selectExpr("*", "1 AS id", "'x' AS whitened").repartition(13)
    got = W.whiten(df, 20).collect()
    x = np.floor(64 * np.concatenate([raw, raw[:1], raw[1:2], raw[1:2]]).astype(np.float64)).astype(np.int64) + 1_000_000
    value, white, share = expected(x.astype(np.float64), 20)
    assert len(got) == len(x) == got[0].n and {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    assert np.abs(np.array(got[0].explained) / share - 1).max() < 1e-9
    deviation = ((len(x) * x - x.sum(0)) ** 2).sum(1)
    where = {i: k for k, i in enumerate([*range(700), None])}
    sign = np.sign(sum(np.array(r.whitened) * white[where[r.vec_id]] for r in got))
    for r in got:
        k = where[r.vec_id]
        assert int(r.deviation) == deviation[k] and np.abs(np.array(r.whitened) * sign - white[k]).max() < 1e-6


def test_numbers_beyond_64_bits(spark):
    """Deviations are exact where squares, and n times the entries, leave 64 bits."""
    rows = [(i, [float(1 << 40) * (i - 3), float(i * i)], 0) for i in range(9)]
    for scale in (64, 1 << 11):
        got = {r.vec_id: r for r in W.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), 2, scale, 0).collect()}
        x = np.array([[int(scale * v) for v in r[1]] for r in rows], object)
        fits = [i for i in range(9) if abs(int(x[i, 0])) < W.LIMIT]
        x = x[fits]
        want = ((len(x) * x - x.sum(0)) ** 2).sum(1)
        assert {i: int(r.deviation) for i, r in got.items()} == dict(zip(fits, want))


def test_tables_without_variance(spark):
    for rows in ([], [(1, None, 0)], [(1, [], 0)]):
        assert W.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0
    same = W.whiten(spark.createDataFrame([(i, [1.0, 2.0, 3.0], 0) for i in range(4)], SCHEMA)).collect()
    assert len(same) == 4 and all(r.whitened == [] and r.explained == [] and r.deviation == 0 for r in same)
    line = W.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(5)], SCHEMA)).collect()
    assert all(len(r.whitened) == 1 and abs(r.explained[0] - 1) < 1e-12 and r.identity_error < 1e-12 for r in line)


def test_the_query(spark, table_df, tmp_path):
    from toolwarden.llm.whitening_queries import op11_whitening

    got = op11_whitening(spark, "/root/testdata/sf0.001").collect()
    rows = sorted((r.vec_id, r.embedding) for r in table_df("embeddings").collect())
    value, white, share = expected(np.floor(64 * np.array([v for _, v in rows], float)), 32)
    found = np.zeros((len(rows), 32))
    place = {i: k for k, (i, _) in enumerate(rows)}
    for r in got:
        found[place[r.vec_id], r.component - 1] = r.whitened
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-9 and r.n == len(rows) and r.identity_error < 1e-9
    sign = np.sign((found * white).sum(0))
    assert len(got) == 32 * len(rows) and np.abs(found * sign - white).max() < 1e-8
