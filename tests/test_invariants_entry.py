import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from varscope.operators.association import correlation_pvalues
from varscope.operators.anova import eta_squared

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@needs_data
def test_grouped_equals_per_group(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    grouped = {(r["l_returnflag"], r["column_a"], r["column_b"]): r["r"]
               for r in correlation_pvalues(li, cols, by=["l_returnflag"]).collect()}
    for flag in ["A", "N", "R"]:
        for r in correlation_pvalues(li.where(F.col("l_returnflag") == flag), cols).collect():
            assert abs(grouped[(flag, r["column_a"], r["column_b"])] - r["r"]) < 1e-12


@needs_data
def test_partitioning_does_not_change_results(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    a = eta_squared(o.repartition(1), "o_totalprice", ["o_orderstatus", "o_orderpriority"]).orderBy("group_col").collect()
    b = eta_squared(o.repartition(7), "o_totalprice", ["o_orderstatus", "o_orderpriority"]).orderBy("group_col").collect()
    for x, y in zip(a, b):
        assert abs(x["eta_squared"] - y["eta_squared"]) < 1e-12 and x["n"] == y["n"]


def _same(a, b):
    if a is None or b is None:
        return a is b
    if isinstance(a, float) or isinstance(b, float):
        return a == b or math.isnan(a) and math.isnan(b) or abs(a - b) <= 1e-6 * max(abs(a), abs(b))
    return a == b


@needs_data
def test_entry_and_every_query_match_their_oracle(spark):
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    for name, fn in E.queries().items():
        df = fn(spark, SF)
        cols = sorted(df.columns)
        rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
        assert cols, name
        if name in E.oracle_sql():
            want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({E.oracle_sql()[name]}) q").fetchall()
            assert len(rows) == len(want), name
            key = lambda r: tuple(f"{v:.4g}" if isinstance(v, float) else str(v) for v in r)
            for a, b in zip(sorted(rows, key=key), sorted(want, key=key)):
                assert all(map(_same, a, b)), (name, a, b)
