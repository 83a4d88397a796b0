import numpy as np
from pyspark.sql import functions as F

from conftest import frame
from varscope.operators.anova import (confounders, eta_squared, segment_rates, significant_subgroups)
from varscope.operators.association import correlation_matrix, correlation_pvalues, pair_stats, top_pairs


def test_pairwise_complete_correlation_matches_numpy(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=200)
    b = 0.6 * a + rng.normal(size=200)
    c = rng.normal(size=200)
    b[::7] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in t) for t in zip(a, b, c)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["column_a"], r["column_b"]): r for r in correlation_pvalues(df).collect()}
    m = ~np.isnan(b)
    assert got[("a", "b")]["n"] == m.sum()
    assert abs(got[("a", "b")]["r"] - np.corrcoef(a[m], b[m])[0, 1]) < 1e-12
    assert got[("a", "b")]["significant"] and got[("a", "b")]["p_value"] < 1e-6
    assert abs(got[("a", "c")]["r"] - np.corrcoef(a, c)[0, 1]) < 1e-12


def test_wide_query_returns_every_pair(spark, tmp_path):
    from varscope.plans.q_association import WIDE, q_corr_wide
    rng = np.random.default_rng(7)
    cols = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    data = rng.uniform(0.01, 1, size=(80, 4)) * (50, 1000, 0.1, 0.08)
    spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"{c} double" for c in cols)) \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["column_a"], r["column_b"]): r for r in q_corr_wide(spark, str(tmp_path)).collect()}
    want = np.corrcoef([data[:, cols.index(c)] ** e for c, e in WIDE.values()])
    names = list(WIDE)
    assert set(got) == {(a, b) for i, a in enumerate(names) for b in names[i + 1:]} and len(got) == 1770
    for (a, b), r in got.items():
        assert r["n"] == 80 and abs(r["r"] - want[names.index(a), names.index(b)]) < 1e-5


def test_false_discoveries_on_noise_are_rare(spark):
    rng = np.random.default_rng(11)
    data = rng.normal(size=(30, 15))
    df = spark.createDataFrame([tuple(float(v) for v in row) for row in data], [f"c{i}" for i in range(15)])
    res = correlation_pvalues(df).collect()
    assert len(res) == 105
    assert sum(r["significant"] for r in res) / len(res) <= 0.15


def test_top_pairs_excludes_derived(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=100)
    df = spark.createDataFrame([(float(x), float(2 * x), float(x + rng.normal())) for x in a], "a double, b double, c double")
    pv = correlation_pvalues(df)
    ex = spark.createDataFrame([("a", "b")], "column_a string, column_b string")
    top = top_pairs(pv, 5, exclude=ex).collect()
    assert ("a", "b") not in {(r["column_a"], r["column_b"]) for r in top}


def test_eta_squared_edges(spark):
    df = frame(spark, {"g": ["a"] * 5 + ["b"] * 5 + ["c"] * 5, "y": [1.0] * 5 + [2.0] * 5 + [3.0] * 5})
    r = eta_squared(df, "y", "g").first()
    assert r["eta_squared"] == 1.0 and r["p_value"] == 0.0 and r["f_statistic"] == float("inf")
    single = frame(spark, {"g": ["a", "b"], "y": [1.0, 2.0]})
    r = eta_squared(single, "y", "g", min_group_size=2).first()
    assert r["reliable"] is False and r["p_value"] == 1.0 and r["f_statistic"] == 0.0


def test_eta_and_f_match_numpy(spark):
    rng = np.random.default_rng(9)
    g = rng.integers(0, 4, 300)
    y = g * 0.5 + rng.normal(size=300)
    df = spark.createDataFrame([(f"g{k}", float(v)) for k, v in zip(g, y)], "g string, y double")
    r = eta_squared(df, "y", "g").first()
    grand = y.mean()
    ssb = sum((g == k).sum() * (y[g == k].mean() - grand) ** 2 for k in range(4))
    ssw = sum(((y[g == k] - y[g == k].mean()) ** 2).sum() for k in range(4))
    f = (ssb / 3) / (ssw / 296)
    assert abs(r["eta_squared"] - ssb / (ssb + ssw)) < 1e-12 and abs(r["f_statistic"] - f) < 1e-9


def test_subgroups_confounders_and_rates(spark):
    rng = np.random.default_rng(4)
    grp = np.repeat(["g1", "g2", "g3", "g4"], 10)
    shift = {"g1": 0.0, "g2": 5.0, "g3": 10.0, "g4": 5.0}
    x = np.array([shift[k] for k in grp]) + rng.normal(size=40)
    y = np.array([shift[k] ** 2 / 10 for k in grp]) + rng.normal(size=40) * 0.3
    noise = rng.choice(["u", "v"], size=40)
    df = spark.createDataFrame([(a, b, float(c), float(d)) for a, b, c, d in zip(grp, noise, x, y)],
                               "confounder string, noise string, x double, y double")
    conf = {r["column"] for r in confounders(df, "y", "x").collect()}
    assert conf == {"confounder"}
    sub = {r["group_col"] for r in significant_subgroups(df, "y").collect()}
    assert sub == {"confounder"}
    rates = segment_rates(df.withColumn("flag", (df.y > 3).cast("int")), "flag", ["confounder"]).collect()
    assert [r["level"] for r in sorted(rates, key=lambda r: r["rank"])][0] == "g3"


def test_pairs_with_gaps_by_segment(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(300, 18)) * np.logspace(0, 6, 18) + np.arange(18) ** 3
    data[:, 1] += data[:, 0] * 3
    data[rng.uniform(size=data.shape) < 0.1] = np.nan
    data[:, 5] = 0.1                                                    # constant everywhere
    seg = rng.choice(["a", "b"], 300)
    data[seg == "b", 7] = 3.3                                           # constant in one segment
    rows = [(str(s), *[None if np.isnan(v) else float(v) for v in r]) for s, r in zip(seg, data)]
    cols = [f"c{i}" for i in range(18)]
    df = spark.createDataFrame(rows, ["seg", *cols])
    got = {(r["seg"], r["idx_a"], r["idx_b"]): r for r in pair_stats(df, cols, by=["seg"]).collect()}
    assert len(got) == 2 * 18 * 17 // 2
    for (s, i, j), r in got.items():
        x, y = data[seg == s][:, i], data[seg == s][:, j]
        ok = ~np.isnan(x) & ~np.isnan(y)
        assert r["n"] == ok.sum()
        if x[ok].std() < 1e-12 * abs(x[ok]).max() or y[ok].std() < 1e-12 * abs(y[ok]).max():
            assert r["r"] is None
        else:
            assert abs(r["r"] - np.corrcoef(x[ok], y[ok])[0, 1]) < 1e-9
    tested = correlation_pvalues(df, cols).collect()
    assert len(tested) == 17 * 16 // 2 and all("c5" not in (r["column_a"], r["column_b"]) for r in tested)
    square = correlation_matrix(df, cols)
    assert square.count() == 18 * 18


def test_many_columns_are_all_paired(spark):
    df = spark.range(40).select(*[(F.col("id") * (i + 1) + F.col("id") % (i + 2)).cast("double").alias(f"c{i}") for i in range(55)])
    assert correlation_pvalues(df).count() == 55 * 54 // 2
