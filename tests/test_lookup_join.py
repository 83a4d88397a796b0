"""Per-segment tables meet the raw rows without moving them, or spread over salts."""

import re

import pytest
from pyspark.sql import functions as F

from varscope.functions import joins
from varscope.operators.anomaly import iqr_outliers
from varscope.operators.whatif import cross_validation


def rows(spark):
    seg = ["a"] * 60 + ["b"] * 25 + [None] * 15
    return spark.createDataFrame([(s, i, float(i % 17), float((i * 7) % 23)) for i, s in enumerate(seg)], "seg string, k long, x double, y double").repartition(5)


@pytest.mark.parametrize("limit", [joins.LOOKUP_BYTES, 0])
def test_same_rows_either_way(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "LOOKUP_BYTES", limit)
    df = rows(spark)
    means = df.groupBy("seg").agg(F.avg("x").alias("m"))
    got = joins.lookup_join(df, means, ["seg"])
    assert got.columns == [*df.columns, "m"]
    want = {r["seg"]: r["m"] for r in means.collect()}
    assert sorted((r["k"], r["m"]) for r in got.collect()) == sorted((r["k"], want[r["seg"]]) for r in df.collect())
    typed = joins.lookup_join(df, df.groupBy("seg", "x").agg(F.count(F.lit(1)).alias("n")), ["seg"], extra=["x"])
    assert typed.count() == df.count()
    assert ("_salt" in plan(got)) == (limit == 0)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exchange_above_the_raw_scan(spark, tmp_path):
    rows(spark).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for out in (iqr_outliers(df, "x", by=["seg"], key_cols=["k"]),):
        text = plan(out)
        assert "BroadcastHashJoin" in text and not re.search(r"Exchange hashpartitioning", text)
    text = plan(cross_validation(df, "y", "x", ["seg"], key_cols=["k"]))
    below = re.findall(r"partial_sum\(\(x.*?FileScan", text, re.S)    # from the folds' sums down to the scan
    assert below and not any("Exchange hashpartitioning" in b for b in below)
