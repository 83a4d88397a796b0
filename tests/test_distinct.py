"""Distinct counts up to a limit, against Python sets."""

import math

import pytest

from varscope.functions.distinct import few_distinct, few_distinct_columns
from varscope.operators.levels import level_features
from varscope.operators.profile import column_profile


def _rows():
    out = [("one", 7.0)] * 40 + [("zero", v) for v in (0.0, -0.0, 0.0)] + [("none", None)] * 3 + [(None, v) for v in (1.0, 2.0, None, 2.0)]
    out += [("nan", v) for v in (math.nan, math.nan, 1.0, math.inf, -math.inf)]
    for n in (2, 24, 25, 26, 27, 300):
        out += [(f"k{n}", float(i % n) * 1.7 - 3) for i in range(3 * n)]
    return out


@pytest.mark.parametrize("bits", [None, 4])
@pytest.mark.parametrize("limit", [1, 25])
def test_counts(spark, bits, limit):
    rows = _rows()
    sets = {}
    for k, v in rows:
        if v is not None:
            sets.setdefault(k, set()).add("nan" if math.isnan(v) else v + 0.0)
    got = {r["k"]: r["n_distinct"] for r in few_distinct(spark.createDataFrame(rows, "k string, value double"), ["k"], limit,
                                                         round_bits=bits).collect()}
    assert got == {k: min(len(s), limit + 1) for k, s in sets.items()}


def test_empty(spark):
    assert few_distinct(spark.createDataFrame([], "k string, value double"), ["k"]).collect() == []


def test_values_do_not_move(spark):
    """Rows leave a task as cells: the exchange of the first round has at most 1024 rows a key and task."""
    df = spark.range(0, 200_000, 1, 4).selectExpr("'a' AS k", "CAST(id AS DOUBLE) AS value")
    from varscope.functions import distinct
    cells = distinct._split(df.selectExpr("k", "value AS _v"), ["k"], distinct.ROUND_BITS)
    r = cells.selectExpr("single + size(pending) AS cells").first()
    assert r["cells"] == 1 << distinct.ROUND_BITS
    assert few_distinct(df, ["k"]).first()["n_distinct"] == 26


def test_profile_and_levels(spark):
    df = spark.range(600).selectExpr("CAST(id % 3 AS STRING) AS g", "CAST(id % 20 AS DOUBLE) * 10 AS level", "CAST(id AS DOUBLE) AS many")
    exact = {(r["g"], r["column"]): r["n_distinct"] for r in column_profile(df, ["level", "many"], ["g"]).collect()}
    few = {(r["g"], r["column"]): r["n_distinct"] for r in column_profile(df, ["level", "many"], ["g"], count_to=25).collect()}
    assert exact == {(g, c): 20 if c == "level" else 200 for g in "012" for c in ("level", "many")}
    assert few == {k: min(v, 26) for k, v in exact.items()}
    got = {r["column"]: (r["n_distinct"], r["mean_gap"], r["is_level_feature"]) for r in level_features(df, ["level", "many"]).collect()}
    assert got == {"level": (20, 10.0, True), "many": (None, None, False)}


def test_many_columns(spark):
    df = spark.range(300).selectExpr("id AS whole", "CAST(id % 4 AS STRING) AS text", "id % 2 = 0 AS flag", "DATE'2024-01-01' AS day",
                                     "CAST('NaN' AS DOUBLE) AS missing", "CAST(id AS STRING) AS many", "CAST(NULL AS STRING) AS none")
    got = {r["column"]: r["n_distinct"] for r in few_distinct_columns(df, df.columns, 10).collect()}
    assert got == {"whole": 11, "text": 4, "flag": 2, "day": 1, "many": 11}
