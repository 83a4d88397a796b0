import numpy as np

from conftest import frame
from varscope.operators.regression import fit_simple_regression, logistic, ols_multi, ols_simple, one_hot


def test_ols_simple_matches_polyfit(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 100, 80)
    y = 3 - 0.5 * x + rng.normal(size=80)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    r = ols_simple(df, "y", "x").first()
    b, a = np.polyfit(x, y, 1)
    assert abs(r["slope"] - b) < 1e-10 and abs(r["intercept"] - a) < 1e-8
    assert abs(r["r_squared"] - np.corrcoef(x, y)[0, 1] ** 2) < 1e-12 and r["status"] == "ok"


def test_ols_status_guards(spark):
    const = frame(spark, {"x": [1.0, 1.0, 1.0, 1.0], "y": [1.0, 2.0, 3.0, 4.0]})
    assert ols_simple(const, "y", "x").first()["status"] == "zero_variance"
    tiny = frame(spark, {"x": [1.0, 2.0], "y": [1.0, 2.0]})
    assert ols_simple(tiny, "y", "x").first()["status"] == "insufficient_rows"


def test_ols_multi_and_condition_number(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=100)
    b_col = 2.001 * a + rng.normal(size=100) * 0.001
    c = rng.normal(size=100)
    y = 1 + 2 * a - c + rng.normal(size=100) * 0.1
    df = spark.createDataFrame([tuple(map(float, t)) for t in zip(a, b_col, c, y)], "a double, b double, c double, y double")
    r = ols_multi(df, "y", ["a", "c"]).first()
    X = np.column_stack([np.ones(100), a, c])
    coef = np.linalg.lstsq(X, y, rcond=None)[0]
    assert abs(r["intercept"] - coef[0]) < 1e-9 and abs(r["coefficients"]["a"] - coef[1]) < 1e-9
    Z = np.column_stack([np.ones(100), (a - a.mean()) / a.std(ddof=1), (c - c.mean()) / c.std(ddof=1)])
    assert abs(r["condition_number"] - np.linalg.cond(Z)) < 1e-6 and r["multicollinearity_warning"] is False
    r2 = ols_multi(df, "y", ["a", "b"]).first()
    assert r2["condition_number"] > 100 and r2["multicollinearity_warning"] is True


def test_logistic_matches_newton_and_switch(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(2, 1.5, 400)
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(-1 + 0.8 * x)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    r = logistic(df, "y", "x").first()
    beta = np.zeros(2)
    X = np.column_stack([np.ones(400), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ beta))
        beta += np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]), X.T @ (y - p))
    assert abs(r["intercept"] - beta[0]) < 1e-7 and abs(r["coefficient"] - beta[1]) < 1e-7
    assert 0 <= r["r_squared"] <= 1 and r["converged"]
    assert fit_simple_regression(df, "y", "x").first()["model_type"] == "logistic"


def test_logistic_separation_stays_in_bounds(spark):
    df = frame(spark, {"x": [float(i) for i in range(20)], "y": [0.0] * 10 + [1.0] * 10})
    r = logistic(df, "y", "x").first()
    assert abs(r["coefficient"]) <= 10 and abs(r["intercept"]) <= 10


def box_optimum(x, y, bound=10.0):
    """Best log-likelihood over the box: coordinate-wise convex, so nested golden sections on a wide set of values."""
    def ll(b0, b1):
        z = b0 + b1 * x
        return float(np.sum(y * z - np.logaddexp(0, z)))

    def golden(f):
        lo, hi, r = -bound, bound, (5 ** 0.5 - 1) / 2
        for _ in range(90):
            p, q = hi - r * (hi - lo), lo + r * (hi - lo)
            lo, hi = (p, hi) if f(p) < f(q) else (lo, q)
        return max(f(v) for v in (lo, hi, -bound, bound))
    return golden(lambda b1: golden(lambda b0: ll(b0, b1))), ll


def test_logistic_box_optimum_in_few_scans(spark):
    """Separable, unscaled, shifted, one-sided and constant data: the optimum over the box, in at most 12 scans."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=120)
    noisy = (rng.uniform(size=120) < 1 / (1 + np.exp(-x))).astype(float)
    line = np.arange(20.0)
    data = {"separable": (line, (line >= 10) * 1.0), "separable_far": (line * 1e6, (line >= 10) * 1.0),
            "unscaled": (x * 1e6, noisy), "tiny": (x * 1e-6, noisy), "shifted": (x + 1e5, noisy), "steep": (x * 1e-2, (x > 0) * 1.0),
            "constant": (np.full(30, 4.0), (np.arange(30) < 9) * 1.0), "rare": (x, (np.arange(120) == 7) * 1.0),
            "falling": (x, 1.0 - (x > 0.1))}
    rows = [(k, float(a), float(b)) for k, (xs, ys) in data.items() for a, b in zip(xs, ys)]
    rows += [("single", float(i), 1.0) for i in range(5)] + [(None, float(i % 7), float(i % 2)) for i in range(30)] + [("nulls", None, 1.0)]
    got = {r["g"]: r for r in logistic(spark.createDataFrame(rows, "g string, x double, y double"), "y", "x", by=["g"]).collect()}
    assert set(got) == {*data, "single", None}
    assert got["single"]["status"] == "single_class" and not got["single"]["converged"]
    for k, (xs, ys) in data.items():
        r = got[k]
        best, ll = box_optimum(xs, ys)
        assert abs(r["intercept"]) <= 10 + 1e-9 and abs(r["coefficient"]) <= 10 + 1e-9, k
        assert ll(r["intercept"], r["coefficient"]) >= best - 1e-9 * len(xs) - 1e-9 * abs(best), k
        assert r["converged"] and r["iterations"] <= 12, (k, r["iterations"])
    assert got["constant"]["coefficient"] == 0 and abs(got["constant"]["intercept"] - np.log(9 / 21)) < 1e-9


def test_logistic_empty(spark):
    assert logistic(spark.createDataFrame([], "g string, x double, y double"), "y", "x", by=["g"]).collect() == []


def test_one_hot(spark):
    df = frame(spark, {"c": ["b", "a", None, "c"], "v": [1, 2, 3, 4]})
    out = one_hot(df)
    assert out.columns == ["v", "c_b", "c_c"]
    assert [tuple(r) for r in out.orderBy("v").collect()] == [(1, 1.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, 0.0, 1.0)]
