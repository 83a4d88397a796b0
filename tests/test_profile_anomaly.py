import numpy as np
import pytest

from conftest import frame
from varscope.operators.anomaly import iqr_bounds, iqr_outliers
from varscope.operators.profile import describe


def test_describe_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(50, 10, 500)
    y = rng.integers(0, 9, 500).astype(float)
    y[::10] = np.nan
    df = spark.createDataFrame([(float(a), None if np.isnan(b) else float(b)) for a, b in zip(x, y)], "x double, y double")
    got = {r["column"]: r for r in describe(df).collect()}
    for name, v in (("x", x), ("y", y[~np.isnan(y)])):
        r = got[name]
        assert r["n"] == len(v)
        assert abs(r["mean"] - v.mean()) < 1e-9 and abs(r["std"] - v.std(ddof=1)) < 1e-9
        assert r["min"] == v.min() and r["max"] == v.max() and abs(r["median"] - np.median(v)) < 1e-12


def test_iqr_known_answer_and_reliability(spark):
    rng = np.random.default_rng(17)
    vals = np.append(rng.normal(40, 3, 23).round(2), 412.5)
    df = frame(spark, {"id": list(range(24)), "v": [float(v) for v in vals]})
    q1, q3 = np.percentile(vals, [25, 75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    out = [float(v) for v in vals if v < low or v > high]
    b = iqr_bounds(df, ["v"]).first()
    assert 412.5 in out and b["n_outliers"] == len(out) and b["reliable"] is False
    assert sorted(r["value"] for r in iqr_outliers(df, "v", key_cols=["id"]).collect()) == sorted(out)
    assert abs(b["lower_bound"] - low) < 1e-9
    big = frame(spark, {"v": [float(i % 13) for i in range(50)]})
    assert iqr_bounds(big, ["v"]).first()["reliable"] is True
    with pytest.raises(ValueError):
        iqr_bounds(df, ["v"], k=0)


def test_iqr_counts_nulls_in_n(spark):
    df = spark.createDataFrame([(float(i),) for i in range(28)] + [(None,), (None,)], "v double")
    b = iqr_bounds(df, ["v"]).first()
    assert b["n"] == 30 and b["n_valid"] == 28 and b["reliable"] is True


def test_describe_approx_switch(spark):
    rng = np.random.default_rng(4)
    x = rng.exponential(5, 5000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    approx = describe(df, accuracy="approx").first()
    exact = describe(df).first()
    assert abs(exact["median"] - np.median(x)) < 1e-12
    # percentile_approx: rank error within n / accuracy
    rank = (x < approx["median"]).mean()
    assert abs(rank - 0.5) <= 1 / 10_000 + 1 / len(x)
    assert approx["n"] == exact["n"] == 5000


def test_quantiles_of_extreme_ranges(spark):
    from varscope.functions.quantiles import exact_quantiles
    rng = np.random.default_rng(6)
    v = np.concatenate([10.0 ** rng.uniform(-300, 300, 1500), -(10.0 ** rng.uniform(-300, 300, 1400)), np.zeros(100), [5e-324, 1e308]])
    df = spark.createDataFrame([("a", float(x)) for x in v], "k string, value double")
    got = exact_quantiles(df, ["k"], "value", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0], collect_limit=100).first()["quantiles"]
    s = np.sort(v)
    for p, g in zip([0.0, 0.1, 0.25, 0.5, 0.9, 1.0], got):
        h = (len(s) - 1) * p
        want = s[int(h)] + (h - int(h)) * (s[min(int(h) + 1, len(s) - 1)] - s[int(h)])
        assert g is not None and (g == want or abs(g - want) <= 1e-9 * abs(want))
