from pyspark.sql import functions as F

from varscope.operators import findings as FD


def _score(spark, n_rows, n_findings, n_anom, r2, actionable):
    df = spark.createDataFrame([(n_rows, n_findings, n_anom, r2, actionable)],
                               "n long, k long, a long, r2 double, act boolean")
    s, level = FD.score(F.col("n"), F.col("k"), F.col("a"), F.col("r2"), F.col("act"))
    row = df.select(s.alias("s"), level.alias("l")).first()
    return row["s"], row["l"]


def test_score_rules(spark):
    assert _score(spark, 100, 2, 0, None, None) == (100, "green")
    assert _score(spark, 20, 4, 1, 0.5, True) == (100 - 25 - 10 - 5, "orange")
    assert _score(spark, 10, 20, 0, 0.005, False) == (0, "red")
    assert _score(spark, 100, 0, 0, 0.5, False) == (69, "orange")
    assert _score(spark, 100, 9, 0, 0.2, True) == (100 - 40 - 15, "orange")


def test_main_insight_priority(spark):
    rows = [("TOP_PAIR", "low", "correlation", ["a", "b"], 0.9, 7),
            ("CONFOUNDER", "high", "correlation", ["g", "x", "y"], 0.3, 2),
            ("CONFOUNDER", "high", "correlation", ["h", "u", "v"], 0.8, 2)]
    df = spark.createDataFrame(rows, FD.FINDING_SCHEMA)
    top = FD.main_insight(df, ["x", "y"]).first()
    assert top["code"] == "CONFOUNDER" and top["columns"] == ["g", "x", "y"]
    assert FD.main_insight(df).first()["columns"] == ["h", "u", "v"]


def test_dedupe_codes(spark):
    rows = [("MULTIPLE_TESTING", "medium", "correlation", [], 6.0, 8),
            ("MULTIPLE_TESTING", "medium", "correlation", [], 9.0, 8),
            ("ANOMALY", "medium", "quality", ["a"], 1.0, 8),
            ("ANOMALY", "medium", "quality", ["b"], 2.0, 8)]
    df = spark.createDataFrame(rows, FD.FINDING_SCHEMA)
    out = FD.dedupe_codes(df).collect()
    assert sorted(r["code"] for r in out) == ["ANOMALY", "ANOMALY", "MULTIPLE_TESTING"]
    assert [r["metric"] for r in out if r["code"] == "MULTIPLE_TESTING"] == [9.0]
