"""Wide tables: sums by matrix products give what one aggregate per pair gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varscope.functions import tiles
from varscope.operators import association, shape


def wide(spark, n=400, seed=4):
    rng = np.random.default_rng(seed)
    seg = rng.choice(["a", "b", None], n, p=[0.7, 0.28, 0.02])
    x = rng.normal(size=n)
    cols = {
        "c0": x, "c1": x ** 2 + 0.1 * rng.normal(size=n), "c2": np.where(rng.random(n) < 0.3, None, x + rng.normal(size=n)),
        "c3": np.full(n, 4.5), "c4": rng.integers(0, 3, n).astype(float), "c5": 1e4 + rng.normal(size=n),
        "c6": np.where(seg == "a", 7.0, rng.normal(size=n)),                       # constant in one segment
        "c7": np.where(x > 0.5, np.floor(x * 4), -1.0), "c8": [None] * n, "c9": np.where(rng.random(n) < 0.98, None, x),
    }
    # constant wherever c2 is present, though not as a whole
    cols["c10"] = np.where([v is None for v in cols["c2"]], rng.normal(size=n), 3.25)
    # a subset far from the column's mean
    cols["c11"] = np.where([v is None for v in cols["c2"]], 1e6 * rng.normal(size=n), 1e6 + 1e-3 * rng.normal(size=n))
    rows = [(None if s is None else str(s), i % 2, *[None if v[i] is None else float(v[i]) for v in cols.values()]) for i, s in enumerate(seg)]
    schema = "seg string, half int, " + ", ".join(f"{c} double" for c in cols)
    return spark.createDataFrame(rows, schema).repartition(3), list(cols)


def keyed(df, keys):
    out = {}
    for r in df.collect():
        d = r.asDict()
        key = tuple(d.pop(k) for k in keys)
        assert key not in out
        out[key] = d
    return out


def close(a, b, rel=1e-9, abs_=1e-12):
    assert a.keys() == b.keys()
    for k in a:
        for c, v in a[k].items():
            w = b[k][c]
            if isinstance(v, float) and isinstance(w, float):
                assert v == pytest.approx(w, rel=rel, abs=abs_), (k, c, v, w)
            elif isinstance(v, list) and isinstance(w, list):
                assert v == pytest.approx(w, rel=1e-9), (k, c)
            else:
                assert v == w, (k, c, v, w)


@pytest.mark.parametrize("by", [[], ["seg"], ["seg", "half"]])
def test_pair_stats(spark, by):
    df, cols = wide(spark)
    assert len(cols) > association.DIRECT_COLUMNS
    keys = [*by, "idx_a", "idx_b"]
    from itertools import combinations
    got = keyed(association.pair_stats(df, cols, by).drop("column_a", "column_b"), keys)
    assert len(got) == len(list(combinations(cols, 2))) * df.select(*by).distinct().count() if by else len(got) == 66
    want = keyed(association._direct_stats(df, cols, by, list(combinations(range(len(cols)), 2))), keys)
    close(got, want)


def test_sums_leave_a_task_early(spark, monkeypatch):
    df, cols = wide(spark)
    want = keyed(association.pair_stats(df, cols, ["seg"]), ["seg", "idx_a", "idx_b", "column_a", "column_b"])
    monkeypatch.setattr(tiles, "HELD_BYTES", 0)
    close(keyed(association.pair_stats(df, cols, ["seg"]), ["seg", "idx_a", "idx_b", "column_a", "column_b"]), want)


@pytest.mark.parametrize("by", [[], ["seg"]])
def test_steps(spark, by):
    df, cols = wide(spark)
    cols = cols[:9]
    pairs = [(a, b) for a in cols for b in cols if a != b]
    keys = [*by, "target", "feature"]
    got = keyed(shape.step_patterns(df, pairs, by, keep_all=True), keys)
    want = keyed(shape._step_by_pair(df, pairs, by), keys)
    close(got, want, rel=1e-8, abs_=1e-10)
    assert any(v["detected"] for v in got.values())


def test_quadratic_against_numpy(spark):
    df, cols = wide(spark)
    pairs = [(a, b) for a in cols for b in cols if a != b]
    got = keyed(shape.quadratic_patterns(df, pairs, keep_all=True), ["target", "feature"])
    data = df.toPandas()
    seen = 0
    for (t, f), r in got.items():
        d = data[[t, f]].dropna().astype(float)
        if "c11" in (t, f):
            continue
        x, y = d[f].to_numpy(), d[t].to_numpy()
        z = (x - x.mean()) / x.std()
        a = np.stack([np.ones_like(z), z, z * z], 1)
        if np.linalg.matrix_rank(a) < 3 or y.std() == 0:
            continue
        e = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
        r2 = 1 - (e @ e) / ((y - y.mean()) ** 2).sum()
        assert r["n"] == len(d)
        assert r["r2_quadratic_adj"] == pytest.approx(1 - (1 - r2) * (len(d) - 1) / (len(d) - 3), abs=1e-8), (t, f)
        seen += 1
    assert seen > 40 and got["c1", "c0"]["detected"]


def test_empty_table_and_no_pairs(spark):
    df, cols = wide(spark)
    none = df.where(F.lit(False))
    assert shape.quadratic_patterns(none, [("c0", "c1")]).count() == 0
    assert shape.quadratic_patterns(df, []).count() == 0
    assert association.pair_stats(none, cols, ["seg"]).count() == 0
    assert all(r["r"] is None and r["n"] == 0 for r in association.pair_stats(none, cols).collect())


def test_derived_of_many_columns(spark, monkeypatch):
    from varscope.operators import derived
    rng = np.random.default_rng(8)
    n = 500
    base = rng.uniform(1, 9, (n, 9))
    full = np.concatenate([base, base[:, [0]] * base[:, [1]], base[:, [2]] + base[:, [3]], base[:, [4]] - base[:, [5]]], 1)
    full[:20, 9] += 3                                    # 4 % of the rows differ: still derived
    full[:30, 10] += 3                                   # 6 %: not
    rows = [(("a", "b", "c")[i % 3], *[None if rng.random() < 0.02 else float(x) for x in r]) for i, r in enumerate(full)]
    cols = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame(rows, "seg string, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
    keys = ["target", "col_a", "col_b"]
    clean, trip = derived._candidates(df, cols, [])
    assert len(trip) > derived.REFUTE_FROM
    names = [(cols[t], cols[a], cols[b]) for t, a, b in trip]
    wide, direct = (keyed(f(clean, cols, [], trip), ["t", "a", "b"]) for f in (derived._counted_wide, derived._counted_rows))
    assert wide == direct and len(wide) == len(names)
    kept = derived._survivors(clean, cols, trip)
    assert len(kept) < len(trip) / 4
    got = keyed(derived.derived_relationships(df, cols), [*keys, "form"])
    monkeypatch.setattr(derived, "REFUTE_FROM", 10**9)
    close(got, keyed(derived.derived_relationships(df, cols), [*keys, "form"]))
    assert {("c9", "c0", "c1", "product"), ("c11", "c4", "c5", "difference")} <= set(got)
    assert not any(k[:3] == ("c10", "c2", "c3") for k in got)
    monkeypatch.undo()
    by_segment = keyed(derived.derived_relationships(df, cols, ["seg"]), ["seg", *keys, "form"])
    for seg in "abc":
        one = keyed(derived.derived_relationships(df.where(F.col("seg") == seg), cols), [*keys, "form"])
        close({k[1:]: v for k, v in by_segment.items() if k[0] == seg}, one)


@pytest.mark.parametrize("by", [[], ["seg"]])
def test_wide_centres_hold_no_row_per_value(spark, by):
    """Batches are reduced in the task and give the centres that the long form gives: nulls, NaN, infinities, constants, far means."""
    rows = [("a" if k % 3 else None, 1e6 + k % 7, None if k % 4 else k / 3, 5.0, float("nan") if k % 5 == 0 else (float("inf") if k % 5 == 1 else k * 0.5), None)
            for k in range(200)]
    df = spark.createDataFrame(rows, "seg string, a double, b double, c double, d double, e double").repartition(3)
    cols = ["a", "b", "c", "d", "e"]
    got = {tuple(r[c] for c in by): r for r in tiles.wide_centres(df, cols, by).collect()}
    want = {tuple(r[c] for c in by): r for r in tiles.centres(df, cols, by).collect()}
    assert got.keys() == want.keys()
    for key, w in want.items():
        g = got[key]
        assert g["_n"] == w["_n"]
        for x, y in zip([*g["_mu"], *g["_sd"]], [*w["_mu"], *w["_sd"]]):
            assert (x is None and y is None) or x == pytest.approx(y, rel=1e-9, abs=1e-12)


def test_wide_pairs_are_standardised_in_the_task(spark, monkeypatch):
    """Without segments no expression per column and no row per value is made in the JVM."""
    def never(*_):
        raise AssertionError("the JVM standardises a wide table")
    monkeypatch.setattr(tiles, "standardised", never)
    monkeypatch.setattr(tiles, "centres", never)
    df = spark.range(60).select(*[(F.pow("id", F.lit(1 + i / 10)) + (F.col("id") * (i + 3)) % 7).alias(f"c{i}") for i in range(12)])
    got = {(r["column_a"], r["column_b"]): r["r"] for r in association.pair_stats(df).collect()}
    assert len(got) == 66
    assert got["c0", "c11"] == pytest.approx(df.select(F.corr("c0", "c11")).first()[0], rel=1e-12)
