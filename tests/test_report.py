import numpy as np

from varscope.plans.report import generate_report


def test_report_finds_planted_issues(spark):
    rng = np.random.default_rng(12)
    n = 60
    region = np.array(["north", "south", "east"])[np.arange(n) % 3]
    effect = {"north": 0.0, "south": 40.0, "east": 80.0}
    x = rng.uniform(10, 20, n)
    x[7] = 200.0                                            # planted outlier
    price = rng.uniform(1, 10, n)
    qty = rng.integers(1, 10, n).astype(float)
    y = np.array([effect[r] for r in region]) + 0.5 * x + rng.normal(size=n)
    rows = [(i, str(r), float(a), float(p), float(q), float(p * q), float(b))
            for i, (r, a, p, q, b) in enumerate(zip(region, x, price, qty, y))]
    df = spark.createDataFrame(rows, "id long, region string, x double, price double, qty double, total double, y double")
    rep = generate_report(df, target="y", feature="x", change_pct=0.1, key_cols=["id"])
    codes = {r["code"] for r in rep["findings"].collect()}
    assert "DERIVED" in codes                              # total = price * qty
    assert "ANOMALY" in codes                              # x[7]
    assert "SUBGROUP_DOMINANT_STRONG" in codes             # region explains y
    roles = {r["column"]: r["role"] for r in rep["column_types"].collect()}
    assert roles["id"] == "numeric_discrete" and roles["region"] == "categorical"
    assert {r["column"] for r in rep["column_types"].where("is_identifier").collect()} == {"id"}
    s = rep["score"].first()
    assert 0 <= s["score"] <= 100 and s["level"] in {"green", "orange", "red"}
    assert rep["main_insight"].count() == 1


def test_report_flags_nonlinear_scenario(spark):
    rng = np.random.default_rng(5)
    x = np.linspace(-10, 10, 60)
    y = 50 - x ** 2 + rng.normal(size=60)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    rep = generate_report(df, target="y", feature="x", change_pct=0.1, key_cols=["id"])
    codes = {r["code"] for r in rep["findings"].collect()}
    assert "SCENARIO_NONLINEAR" in codes and "NONLINEAR_QUAD" in codes


def test_report_of_constant_columns_and_rules_that_replace(spark):
    rng = np.random.default_rng(30)
    n = 60
    q = rng.uniform(1, 9, n)
    price = rng.uniform(2, 5, n)
    df = spark.createDataFrame([(float(a), float(b), float(a * b), 4.5) for a, b in zip(q, price)], "q double, price double, total double, fixed double")
    rep = generate_report(df)
    found = rep["findings"].collect()
    codes = [r["code"] for r in found]
    assert codes.count("DERIVED") == 1 and "TOP_PAIR" not in codes
    assert sorted(next(r["columns"] for r in found if r["code"] == "DERIVED")) == ["price", "q", "total"]
    assert not any(set(r["columns"]) == {"q", "total"} for r in found if r["code"].startswith("NONLINEAR"))
    assert all("fixed" not in (r["column_a"], r["column_b"]) for r in rep["correlations"].collect())
    assert rep["score"].first()["n_findings"] == len(found)
