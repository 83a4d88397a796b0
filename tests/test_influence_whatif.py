import numpy as np

from conftest import frame
from varscope.operators.influence import cooks_distance, influential_points
from varscope.operators.whatif import cross_validation, scenario_table, simulate


def test_cooks_flags_the_planted_point(spark):
    rng = np.random.default_rng(0)
    x = np.arange(1, 30, dtype=float)
    y = 2 * x + rng.normal(size=29)
    x = np.append(x, 15.0)
    y = np.append(y, 55.0)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    rows, summary = influential_points(df, "x", "y", ["id"])
    s = summary.first()
    assert s["max_distance_key"] == 29 and 29 in {r["id"] for r in rows.collect()}
    assert abs(s["threshold"] - 4 / 30) < 1e-12
    # closed form equals the textbook formula
    X = np.column_stack([np.ones(30), x])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - X @ beta
    h = 1 / 30 + (x - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum()
    d = e ** 2 / (2 * (e ** 2).sum() / 28) * h / (1 - h) ** 2
    got = {r["x"] * 1000 + r["y"]: r["cooks_d"] for r in cooks_distance(df, "x", "y").collect()}
    assert abs(got[15.0 * 1000 + 55.0] - d[-1]) < 1e-9


def test_cooks_perfect_fit_is_zero(spark):
    df = frame(spark, {"x": [float(i) for i in range(30)], "y": [2.0 * i + 1 for i in range(30)]})
    assert {r["cooks_d"] for r in cooks_distance(df, "x", "y").collect()} == {0.0}


def test_simulation_baseline_and_reliability(spark):
    x = [float(v) for v in (45, 60, 80, 120, 150, 300, 420, 600, 750, 870)]
    y = [120.0, 110.0, 104.0, 100.0, 95.0, 85.0, 70.0, 50.0, 40.0, 35.0]
    df = frame(spark, {"Prix": x, "Ventes": y})
    sc = scenario_table(spark, [0.05])
    r = simulate(df, "Ventes", "Prix", sc, with_levels=False).first()
    assert abs(r["baseline"] - np.mean(y)) < 1e-9 and r["simulated"] < r["baseline"]
    zero = simulate(df, "Ventes", "Prix", scenario_table(spark, [0.5], baseline_feature_value=0.0), with_levels=False).first()
    assert zero["simulated"] == zero["baseline"]
    rng = np.random.default_rng(1)
    xs = rng.uniform(0, 1, 20)
    near = frame(spark, {"x": list(map(float, xs)), "y": list(map(float, 100 * (xs - xs.mean()) + rng.normal(size=20) * 30))})
    r = simulate(near, "y", "x", scenario_table(spark, [0.1]), with_levels=False).first()
    assert r["change_pct_result"] is None and r["change_pct_reliable"] is False


def test_cross_validation(spark):
    rng = np.random.default_rng(2)
    noise = frame(spark, {"k": list(range(130)), "x": list(map(float, rng.normal(size=130))),
                          "y": list(map(float, rng.normal(size=130)))})
    assert cross_validation(noise, "y", "x", key_cols=["k"]).first()["cv_r2_mean"] < 0.1
    lv = rng.integers(1, 6, 115).astype(float)
    sal = frame(spark, {"k": list(range(115)), "x": list(map(float, lv)), "y": list(map(float, 2000 + 500 * lv + rng.normal(size=115) * 100))})
    assert cross_validation(sal, "y", "x", key_cols=["k"]).first()["cv_r2_mean"] > 0.5
    small = frame(spark, {"x": list(map(float, range(18))), "y": list(map(float, range(18))), "k": list(range(18))})
    assert cross_validation(small, "y", "x", key_cols=["k"]).first()["cv_r2_mean"] is None


def test_cross_validation_of_one_fold_and_without_key(spark):
    import pytest
    df = frame(spark, {"g": ["a"] * 30 + ["b"] * 30, "x": [float(i % 11) for i in range(60)],
                       "y": [float(i % 7) for i in range(60)], "f": [0] * 30 + [i % 5 for i in range(30)]})
    got = {r["g"]: r for r in cross_validation(df, "y", "x", by=["g"], fold_col="f").collect()}
    assert got["a"]["cv_r2_mean"] is None and got["b"]["cv_r2_mean"] is not None
    with pytest.raises(ValueError):
        cross_validation(df, "y", "x")
