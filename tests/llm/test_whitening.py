"""op13 against numpy's eigenvectors and exact integers."""

import math

import numpy as np
import pytest

from varscope.llm import whitening
from varscope.llm.queries import REGISTRY


def vectors(seed=1, n=400, d=12):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) * np.geomspace(1, 0.05, d)) @ np.linalg.qr(rng.normal(size=(d, d)))[0]
    return x.astype(np.float32)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, width string").repartition(3)


def check(rows, data, components=8):
    x = np.floor(np.float64(1024) * np.array([v for _, v in data], np.float64)).astype(np.int64) + 100_000
    n, s = len(x), [int(c) for c in x.sum(0)]
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    dev = {}
    for (i, _), row in zip(data, x.tolist()):
        dev.setdefault(i, set()).add(sum((n * v - t) ** 2 for v, t in zip(row, s)))
    assert len(rows) == n * components and {r["n"] for r in rows} == {n}
    assert all(r["deviation"] in dev[r["vec_id"]] for r in rows)
    assert {round(r["identity_error"], 12) for r in rows} == {round(rows[0]["identity_error"], 12)} and rows[0]["identity_error"] < 1e-9
    for k in range(components):
        got = [r for r in rows if r["component"] == k + 1]
        assert {r["explained"] for r in got} == {got[0]["explained"]}
        assert got[0]["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-10)
        want = c @ u[:, k] / math.sqrt(e[k])
        by_id = sorted(zip([i for i, _ in data], want), key=lambda p: (p[0] is None, p[0], p[1]))
        have = sorted(((r["vec_id"], r["whitened"]) for r in got), key=lambda p: (p[0] is None, p[0], p[1]))
        a, b = np.array([w for _, w in by_id]), np.array([w for _, w in have])
        other = np.array([w for _, w in sorted(((r["vec_id"], -r["whitened"]) for r in got), key=lambda p: (p[0] is None, p[0], p[1]))])
        assert np.allclose(a, b, atol=1e-7) or np.allclose(a, other, atol=1e-7)


def test_against_numpy(spark, tmp_path):
    x = vectors()
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[5].tolist()), (3, x[3].tolist()), (None, x[9].tolist())]
    bad = [(900, None), (901, [float("nan")] * 12), (902, [float("inf"), *[0.0] * 11]), (903, [None, *[0.0] * 11])]
    table(spark, [(i, v, 1, "own", "own") for i, v in data + bad]).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = REGISTRY["op13_whitening"][0](spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(got.dtypes) | {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint"} == dict(got.dtypes)
    rows = got.collect()
    check(rows, data)
    again = {(r["vec_id"], r["component"]): r["whitened"] for r in REGISTRY["op13_whitening"][0](spark, str(tmp_path)).collect() if r["vec_id"] == 7}
    assert all(r["whitened"] == pytest.approx(again[7, r["component"]], abs=1e-7) for r in rows if r["vec_id"] == 7)


def test_lengths_ranks_and_empties(spark):
    x = vectors(2, 60, 5)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(100, [1.0, 2.0]), (101, [3.0, 5.0]), (102, [2.0, 1.0]), (103, []), (104, [7.0]), (105, [1.0] * 3), (106, [1.0] * 3)]
    got = whitening.whiten(table(spark, [(i, v, 0, "", "") for i, v in rows + odd])).collect()
    check([r for r in got if r["vec_id"] < 100], rows, 5)
    check([r for r in got if 100 <= r["vec_id"] < 103], odd[:3], 2)
    assert not [r for r in got if r["vec_id"] > 102]          # one vector, equal ones, empty ones
    assert whitening.whiten(table(spark, [(1, None, 0, "", "")]).filter("vec_id = 0")).count() == 0


def test_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(table(spark, [(1, [1e30, 0.0], 0, "", ""), (2, [0.0, 0.0], 0, "", "")])).collect()


@pytest.mark.parametrize("n,d,rank", [(1, 1, 1), (200, 30, 30), (50, 20, 7), (40, 40, 3), (10, 3, 0)])
def test_factor_and_eigen(n, d, rank):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, rank)) @ (rng.normal(size=(rank, d)) * np.geomspace(1, 1e-3, d)) if rank else np.zeros((n, d))
    a = x.T @ x
    r, order = whitening.pivoted_cholesky(a)
    assert np.allclose(r, np.triu(r)) and np.allclose(r.T @ r, a[np.ix_(order, order)], atol=1e-9 * (1 + np.abs(a).max()))
    values, vectors_ = whitening.eigen(a)
    assert len(values) == np.linalg.matrix_rank(a) and (np.diff(values) <= 0).all()
    assert np.allclose(vectors_.T @ vectors_, np.eye(len(values)), atol=1e-10)
    assert np.allclose(a @ vectors_, vectors_ * values, atol=1e-10 * (1 + values.max(initial=0)))


def test_deviation_beyond_int64_products():
    f = whitening.Fit(10**6, [10**11 + 7, 3], np.zeros(0), np.zeros((2, 0)), 0.0)
    x = np.array([[100_003, 0], [99_000, 1]])
    assert f.deviation(x) == [sum((10**6 * v - s) ** 2 for v, s in zip(row, f.sums)) for row in x.tolist()]
