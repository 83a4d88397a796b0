import numpy as np

from conftest import frame
from varscope.operators.derived import derived_pairs
from varscope.operators.distribution import distribution_profile
from varscope.operators.levels import level_feature_for_simulation, level_features
from varscope.operators.shape import quadratic_patterns, step_patterns


def _df(spark, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(float(v) for v in t) for t in zip(*cols.values())], names)


def test_quadratic_u_curve_and_optimum(spark):
    rng = np.random.default_rng(40)
    x = np.sort(rng.uniform(-7, 9, 37))
    y_u = 4 - 0.3 * x + 0.2 * x ** 2 + rng.normal(size=37) * 0.4
    y_o = 30 + x - 0.8 * x ** 2 + rng.normal(size=37)
    df = _df(spark, x=x, yu=y_u, yo=y_o, line=2 * x - 5 + rng.normal(size=37) * 0.1)
    res = {r["target"]: r for r in quadratic_patterns(df, [("yu", "x"), ("yo", "x"), ("line", "x")]).collect()}
    assert res["yu"]["pattern_type"] == "u_curve" and res["yo"]["pattern_type"] == "optimum"
    assert "line" not in res
    assert abs(res["yu"]["quadratic_coefficient"] - np.polyfit(x, y_u, 2)[0]) < 1e-9
    small = _df(spark, x=x[:8], y=(x[:8] ** 2))
    assert quadratic_patterns(small, [("y", "x")]).count() == 0


def test_step_pattern_found(spark):
    rng = np.random.default_rng(1)
    x = np.arange(60, dtype=float)
    y = np.select([x < 15, x < 30, x < 45], [10.0, 50.0, 20.0], 10.0) + rng.normal(size=60)
    res = step_patterns(_df(spark, x=x, y=y), [("y", "x")]).collect()
    assert len(res) == 1 and res[0]["eta_squared_binned"] > res[0]["r2_linear"]
    assert res[0]["bin_boundaries"] == list(np.percentile(x, [0, 20, 40, 60, 80, 100]))


def test_step_pattern_of_more_rows_than_one_task_sorts(spark, monkeypatch):
    from varscope.functions.quantiles import exact_quantiles
    rng = np.random.default_rng(12)
    x = rng.uniform(0, 60, 400)
    y = np.select([x < 15, x < 30, x < 45], [10.0, 50.0, 20.0], 10.0) + rng.normal(size=400)
    df = _df(spark, x=x, y=y, z=x + rng.normal(size=400))
    pairs = [("y", "x"), ("z", "x")]
    want = step_patterns(df, pairs, keep_all=True).orderBy("target").collect()
    monkeypatch.setitem(exact_quantiles.__kwdefaults__, "collect_limit", 30)
    got = step_patterns(df, pairs, keep_all=True).orderBy("target").collect()
    assert len(got) == len(want) == 2
    for a, b in zip(got, want):
        assert a["bin_boundaries"] == b["bin_boundaries"] and a["n"] == b["n"] and a["detected"] == b["detected"]
        assert abs(a["eta_squared_binned"] - b["eta_squared_binned"]) < 1e-12


def test_distribution_detectors(spark):
    rng = np.random.default_rng(41)
    n = 80
    counts = rng.poisson(1.4, n).astype(float)
    zeros = np.where(rng.uniform(size=n) < 0.7, 0.0, rng.uniform(5, 40, n).round(2))
    heavy = rng.pareto(1.1, n) + 1
    got = {r["column"]: r for r in distribution_profile(_df(spark, counts=counts, zeros=zeros, heavy=heavy)).collect()}
    for name, v in (("counts", counts), ("zeros", zeros), ("heavy", heavy)):
        assert got[name]["n_distinct"] == len(np.unique(v)) and abs(got[name]["zero_ratio"] - (v == 0).mean()) < 1e-12
    assert got["counts"]["is_count_data"] and not got["heavy"]["is_count_data"]
    assert got["zeros"]["is_zero_inflated"] and not got["heavy"]["is_zero_inflated"]
    assert got["heavy"]["is_heavy_tail"] and not got["counts"]["is_heavy_tail"]
    m2 = ((heavy - heavy.mean()) ** 2).mean()
    assert abs(got["heavy"]["skewness"] - ((heavy - heavy.mean()) ** 3).mean() / m2 ** 1.5) < 1e-9


def test_level_features(spark):
    few = _df(spark, v=[1, 2, 3, 1, 2])
    assert not level_features(few).first()["is_level_feature"]
    text = frame(spark, {"t": ["a", "b"] * 10})
    assert level_features(text, ["t"]).count() == 0
    cnt = _df(spark, v=[0, 1, 2, 1, 0, 2, 1, 0, 1, 2, 1, 0])
    assert not level_features(cnt).first()["is_level_feature"]
    many = _df(spark, v=list(range(30)) * 2)
    assert not level_features(many).first()["is_level_feature"]
    const = _df(spark, v=[5] * 20)
    assert not level_features(const).first()["is_level_feature"]
    grid = np.repeat([1000.0, 2000.0, 3000.0, 4000.0], 10)
    rng = np.random.default_rng(2)
    df = _df(spark, grade=grid, salary=grid * 2 + rng.normal(size=40))
    assert level_features(df, ["grade"]).first()["is_level_feature"]
    assert level_feature_for_simulation(df, "grade", "salary").first()["is_level_feature"]


def test_derived_columns(spark):
    rng = np.random.default_rng(3)
    price = rng.uniform(1, 100, 50)
    qty = rng.integers(1, 20, 50).astype(float)
    total = price * qty * (1 + rng.normal(size=50) * 0.001)
    total[::9] = np.nan
    other = rng.normal(size=50)
    rows = [tuple(None if np.isnan(v) else float(v) for v in t) for t in zip(price, qty, total, other)]
    df = spark.createDataFrame(rows, "price double, qty double, total double, other double")
    pairs = {(r["column_a"], r["column_b"]) for r in derived_pairs(df).collect()}
    assert pairs == {("price", "total"), ("qty", "total")}
    noisy = _df(spark, x=price, y=2 * price + rng.normal(size=50) * 10, z=rng.normal(size=50))
    assert derived_pairs(noisy).count() == 0
    sums = _df(spark, a=price, b=qty, s=price + qty, d=price - qty)
    got = {(r["column_a"], r["column_b"]) for r in derived_pairs(sums).collect()}
    assert ("a", "s") in got and ("b", "s") in got and ("a", "d") in got


def test_derived_columns_beyond_thirty(spark):
    rng = np.random.default_rng(9)
    cols = {f"c{i:02d}": rng.uniform(10 * i + 1, 10 * i + 40, 60) for i in range(34)}
    cols["z_total"] = cols["c02"] * cols["c33"]
    got = {(r["column_a"], r["column_b"]) for r in derived_pairs(_df(spark, **cols)).collect()}
    assert ("c02", "z_total") in got and ("c33", "z_total") in got
