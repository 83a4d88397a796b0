import math

import numpy as np
from pyspark.sql import functions as F

from conftest import frame
from varscope.functions.fdr import bh_adjust
from varscope.functions.quantiles import exact_quantiles
from varscope.functions.special import f_sf, pearson_pvalue, t_pvalue


def _t_two_sided(t, nu, hi=400.0, n=400_001):
    x = np.linspace(abs(t), hi, n)
    c = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
    pdf = c * (1 + x * x / nu) ** (-(nu + 1) / 2)
    return 2 * np.trapezoid(pdf, x)


def _f_upper(f, d1, d2, hi=2000.0, n=2_000_001):
    x = np.linspace(f, hi, n)
    lb = math.lgamma(d1 / 2) + math.lgamma(d2 / 2) - math.lgamma((d1 + d2) / 2)
    pdf = np.exp((d1 / 2) * math.log(d1 / d2) + (d1 / 2 - 1) * np.log(x)
                 - ((d1 + d2) / 2) * np.log1p(d1 * x / d2) - lb)
    return np.trapezoid(pdf, x)


def test_t_and_f_pvalues_match_numeric_integration(spark):
    df = spark.createDataFrame([(2.1, 5.0), (1.3, 28.0), (3.0, 200.0)], "t double, nu double")
    got = df.select(t_pvalue(F.col("t"), F.col("nu")).alias("p")).collect()
    for (t, nu), r in zip([(2.1, 5), (1.3, 28), (3.0, 200)], got):
        assert abs(r["p"] - _t_two_sided(t, nu)) < 1e-6
    fd = spark.createDataFrame([(3.2, 2.0, 27.0), (1.1, 4.0, 60.0)], "f double, d1 double, d2 double")
    got = fd.select(f_sf(F.col("f"), F.col("d1"), F.col("d2")).alias("p")).collect()
    for (f, d1, d2), r in zip([(3.2, 2, 27), (1.1, 4, 60)], got):
        assert abs(r["p"] - _f_upper(f, d1, d2)) < 1e-5


def test_pearson_pvalue_equals_t_test(spark):
    r, n = 0.42, 30
    t = r * math.sqrt((n - 2) / (1 - r * r))
    df = spark.createDataFrame([(r, float(n))], "r double, n double")
    p = df.select(pearson_pvalue(F.col("r"), F.col("n"))).first()[0]
    assert abs(p - _t_two_sided(t, n - 2)) < 1e-6


def test_bh_matches_reference_procedure(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.uniform(size=20), rng.uniform(0, 0.01, size=5), [0.5, 0.5]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i long, p double")
    got = dict(bh_adjust(df, "p", "q", tie_break=["i"]).select("i", "q").collect())
    order = np.argsort(p, kind="stable")
    m = len(p)
    adj = p[order] * m / np.arange(1, m + 1)
    adj = np.minimum.accumulate(adj[::-1])[::-1]
    expect = np.empty(m)
    expect[order] = np.minimum(adj, 1)
    for i in range(m):
        assert abs(got[i] - expect[i]) < 1e-12


def test_exact_quantiles_iterative_path_matches_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.exponential(10, 3000), np.full(1500, 4.0), rng.normal(0, 1, 500)])
    keys = rng.integers(0, 3, len(vals))
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, vals)], "k long, value double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]
    # a tiny collect limit forces several split rounds (and the heavy tie at 4.0)
    got = {r["k"]: r["quantiles"] for r in exact_quantiles(df, ["k"], "value", probs, collect_limit=50, bins=16).collect()}
    for k in range(3):
        exp = np.percentile(vals[keys == k], [p * 100 for p in probs])
        assert np.allclose(got[k], exp, rtol=1e-12, atol=1e-12)


def test_exact_quantiles_single_pass(spark):
    df = frame(spark, {"k": [1, 1, 1, 1, 2], "value": [1.0, 2.0, 3.0, 4.0, 5.0]})
    got = {r["k"]: r["quantiles"] for r in exact_quantiles(df, ["k"], "value", [0.25, 0.5]).collect()}
    assert got[1] == [1.75, 2.5] and got[2] == [5.0, 5.0]


def test_exact_quantiles_of_keys_named_as_internal_columns(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.exponential(10, 700), [1e9, 0.0, -3.0]])
    rows = [(i % 2, "x" if i % 3 else None, float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "pid long, rank string, v double")
    few = {(r["pid"], r["rank"]): r["quantiles"] for r in exact_quantiles(df, ["pid", "rank"], "v", [0.25, 0.9], collect_limit=20, bins=16).collect()}
    assert len(few) == 4
    for (pid, rank), got in few.items():
        exp = np.percentile([v for a, b, v in rows if (a, b) == (pid, rank)], [25, 90])
        assert np.allclose(got, exp, rtol=1e-12, atol=1e-12)


def test_materialize_to_few_partitions_leaves_the_steps_before_in_their_tasks(spark):
    from varscope.session import materialize

    def where(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().taskAttemptId()], pa.int64())], ["task"])

    out = materialize(spark.range(0, 80, 1, 8).mapInArrow(where, "task long"), 10)
    assert out.rdd.getNumPartitions() == 1
    assert out.distinct().count() == 8
