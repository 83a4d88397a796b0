"""R1-R3, P5-P7 - simple, multivariate and logistic regression.

* Simple OLS: Spark's ``regr_*`` aggregates (one scan, grouped by segment).
* Multivariate OLS: per segment, the sample covariance matrix of
  ``[features, target]`` is aggregated in one scan (``covar_samp`` is a
  stable co-moment aggregate); a k x k solve then runs per segment inside
  ``applyInPandas`` on that one aggregated row, never on the data.
* Logistic: damped Newton steps over the box, one scan per iteration for all
  segments and several trial steps at once; a segment's state is one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_list, is_numeric, is_text, num
from ..functions.joins import keyed_join, lookup_join
from ..session import materialize

MIN_ROWS_FOR_REGRESSION = 3
CONDITION_NUMBER_WARNING_THRESHOLD = 30
LOGISTIC_BOUND = 10.0


class InsufficientDataError(ValueError):
    """Too few complete rows or a constant column for a regression."""


def _check_numeric(df: DataFrame, cols: Sequence[str]) -> None:
    for c in cols:
        if c not in df.columns:
            raise ValueError(f"column '{c}' does not exist")
    for c in cols:
        if not is_numeric(df, c):
            raise TypeError(f"column '{c}' must be numeric for a regression")


def two_valued(df: DataFrame, col: str, by: Sequence[str] | None = None) -> DataFrame:
    """``by..., two_valued``: exactly two distinct non-null values. The two can only be the least and
    the greatest, so no value is shuffled: a second scan asks for one in between."""
    by = as_list(by)
    x = num(col) if is_numeric(df, col) else F.col(col)
    rows = df.select(*by, x.alias("_t")).where(F.col("_t").isNotNull())
    ends = rows.groupBy(*by).agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    inner = keyed_join(rows, materialize(ends), by)
    out = inner.groupBy(*by).agg((F.bool_and((F.col("_t") == F.col("_lo")) | (F.col("_t") == F.col("_hi")))
                                  & (F.min("_lo") < F.max("_hi"))).alias("two_valued"))
    return out.withColumn("two_valued", F.coalesce("two_valued", F.lit(False)))


def is_two_valued(df: DataFrame, col: str) -> bool:
    row = two_valued(df, col).first()
    return bool(row and row["two_valued"])


def status_col(n: Column, sxx: Column, syy: Column) -> Column:
    """P5 as a status value: ok / insufficient_rows / zero_variance."""
    return (F.when(n < MIN_ROWS_FOR_REGRESSION, F.lit("insufficient_rows"))
            .when((sxx <= 0) | (syy <= 0), F.lit("zero_variance")).otherwise(F.lit("ok")))


def simple_fit_stats(df: DataFrame, target: str, feature: str, by: Sequence[str] | None = None) -> DataFrame:
    """Sufficient statistics of y ~ x on complete rows, per segment."""
    by = as_list(by)
    y, x = num(target), num(feature)
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"), F.regr_avgx(y, x).alias("mean_x"), F.regr_avgy(y, x).alias("mean_y"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))


def ols_from_stats(st: DataFrame) -> DataFrame:
    """slope, intercept, r2, sse, residual std (population) from regr sums."""
    ok = (F.col("n") >= MIN_ROWS_FOR_REGRESSION) & (F.col("sxx") > 0) & (F.col("syy") > 0)
    slope = F.col("sxy") / F.col("sxx")
    sse = F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"))
    return (st.withColumn("status", status_col(F.col("n"), F.col("sxx"), F.col("syy")))
            .withColumn("slope", F.when(ok, slope))
            .withColumn("intercept", F.when(ok, F.col("mean_y") - slope * F.col("mean_x")))
            .withColumn("r_squared", F.when(ok, F.col("sxy") * F.col("sxy") / (F.col("sxx") * F.col("syy"))))
            .withColumn("sse", F.when(ok, sse))
            .withColumn("resid_std", F.when(ok, F.sqrt(sse / F.col("n")))))


def ols_simple(df: DataFrame, target: str, feature: str, by: Sequence[str] | None = None) -> DataFrame:
    """R1 (linear branch): ``by..., target, feature, n, slope, intercept, r_squared, status``."""
    _check_numeric(df, [target, feature])
    by = as_list(by)
    fit = ols_from_stats(simple_fit_stats(df, target, feature, by))
    return fit.select(*by, F.lit(target).alias("target"), F.lit(feature).alias("feature"), "n",
                      "slope", "intercept", "r_squared", "status", "mean_x", "mean_y", "sxx", "syy", "sxy",
                      "resid_std")


def is_binary_target(df: DataFrame, col: str, by: Sequence[str] | None = None) -> DataFrame:
    """Exactly two distinct non-null values (per segment)."""
    by = as_list(by)
    return two_valued(df, col, by).withColumnRenamed("two_valued", "is_binary")


def fit_simple_regression(df: DataFrame, target: str, feature: str, by: Sequence[str] | None = None,
                          encode_categorical: bool = False) -> DataFrame:
    """Linear OLS, or the logistic fit when the target has exactly two values.

    The switch is decided on the whole target column (as the reference does).
    """
    if encode_categorical:
        df = one_hot(df)
    _check_numeric(df, [target, feature])
    if is_two_valued(df, target):
        return logistic(df, target, feature, by).withColumn("model_type", F.lit("logistic"))
    return ols_simple(df, target, feature, by).withColumn("model_type", F.lit("linear"))


# --------------------------------------------------------------------------- multivariate

def _cov_aggs(cols: list[str]) -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(f"m__{i}") for i, c in enumerate(cols)]
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            aggs.append(F.covar_samp(cols[i], cols[j]).alias(f"c__{i}__{j}"))
    return aggs


def ols_multi(df: DataFrame, target: str, features: Sequence[str], by: Sequence[str] | None = None) -> DataFrame:
    """R2: ``by..., target, n, intercept, coefficients (map), r_squared,
    condition_number, multicollinearity_warning, status``."""
    features = list(features)
    _check_numeric(df, features + [target])
    by = as_list(by)
    cols = features + [target]
    clean = df.select(*by, *[num(c).alias(f"_x{i}") for i, c in enumerate(cols)])
    clean = clean.where(reduce(lambda a, b: a & b, [F.col(f"_x{i}").isNotNull() for i in range(len(cols))]))
    xc = [f"_x{i}" for i in range(len(cols))]
    moments = clean.groupBy(*by).agg(*_cov_aggs(xc))
    k = len(features)
    seg_schema = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by)
    schema = (seg_schema + "n long, intercept double, coefficients map<string,double>, r_squared double, "
              "condition_number double, multicollinearity_warning boolean, status string")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            n = int(r["n"])
            out = {b: r[b] for b in by}
            out.update(n=n, intercept=None, coefficients=None, r_squared=None, condition_number=None,
                       multicollinearity_warning=None)
            if n < MIN_ROWS_FOR_REGRESSION:
                out["status"] = "insufficient_rows"
                rows.append(out)
                continue
            cov = np.empty((k + 1, k + 1))
            for i in range(k + 1):
                for j in range(i, k + 1):
                    cov[i, j] = cov[j, i] = r[f"c__{i}__{j}"]
            if np.any(np.diag(cov) <= 0):
                out["status"] = "zero_variance"
                rows.append(out)
                continue
            means = np.array([r[f"m__{i}"] for i in range(k + 1)])
            sxx, sxy, syy = cov[:k, :k], cov[:k, k], cov[k, k]
            beta = np.linalg.lstsq(sxx, sxy, rcond=None)[0]
            intercept = means[k] - beta @ means[:k]
            r2 = float(beta @ sxy / syy)
            d = np.sqrt(np.diag(sxx))
            corr = sxx / np.outer(d, d)
            lam = np.clip(np.linalg.eigvalsh(corr), 0.0, None)
            sv2 = np.concatenate([[n], (n - 1) * lam])
            cond = float(np.sqrt(sv2.max() / sv2.min())) if sv2.min() > 0 else float("inf")
            out.update(intercept=float(intercept),
                       coefficients={features[i]: float(beta[i]) for i in range(k)},
                       r_squared=r2, condition_number=cond,
                       multicollinearity_warning=bool(cond > CONDITION_NUMBER_WARNING_THRESHOLD), status="ok")
            rows.append(out)
        return pd.DataFrame(rows, columns=[*by, "n", "intercept", "coefficients", "r_squared",
                                           "condition_number", "multicollinearity_warning", "status"])

    res = moments.mapInPandas(lambda batches: (solve(p) for p in batches), schema)   # one row a segment
    return res.select(*by, F.lit(target).alias("target"), *[c for c in res.columns if c not in by])


# --------------------------------------------------------------------------- logistic

#: Lengths of the trial steps that one scan evaluates, in Newton steps; long ones for separable classes.
TRIAL_STEPS = (16.0, 4.0, 1.0, 0.25, 1 / 32)
_SUMS = ("ll", "g0", "g1", "h00", "h01", "h11")


def _box_step(a, c, m, s, g, h, bound):
    """The step from (a, c) that maximises the quadratic model with gradient ``g`` and curvature ``h`` over the box.

    a = b0 + b1 m and c = b1 s are the parameters of the standardised feature, in which h is well scaled; the box
    |b0|, |b1| <= bound is a parallelogram there. The maximum is the Newton point, or lies on an edge, where it is the
    edge's own maximum cut to the edge. The step is zero exactly where the KKT conditions hold.
    """
    h00, h01, h11 = h
    best, step = 0.0, (0.0, 0.0)

    def offer(da, dc):
        nonlocal best, step
        gain = g[0] * da + g[1] * dc - 0.5 * (h00 * da * da + 2 * h01 * da * dc + h11 * dc * dc)
        if np.isfinite(gain) and gain > best:
            best, step = gain, (da, dc)

    det = h00 * h11 - h01 * h01
    if h11 <= 0 or det <= 1e-14 * h00 * h11:
        da, dc = (g[0] / h00 if h00 > 0 else np.inf), 0.0
    else:
        da, dc = (h11 * g[0] - h01 * g[1]) / det, (h00 * g[1] - h01 * g[0]) / det
    b1 = (c + dc) / s
    if abs(b1) <= bound and abs(a + da - b1 * m) <= bound:
        offer(da, dc)
        return step, best
    for end in (-bound, bound):
        # (start, direction): b1 = end with b0 free, and b0 = end with b1 free
        for (pa, pc), (va, vc) in (((end * m, end * s), (1.0, 0.0)), ((end, 0.0), (m, s))):
            oa, oc = pa - a, pc - c
            slope = (g[0] - h00 * oa - h01 * oc) * va + (g[1] - h01 * oa - h11 * oc) * vc
            curve = h00 * va * va + 2 * h01 * va * vc + h11 * vc * vc
            t = slope / curve if curve > 0 else np.sign(slope) * np.inf
            t = min(bound, max(-bound, t))
            offer(oa + t * va, oc + t * vc)
    return step, best


def _reach(a, c, da, dc, m, s, bound):
    """How often the step fits between (a, c) and the box's border."""
    most = np.inf
    for at, by in ((c / s, dc / s), (a - c * m / s, da - dc * m / s)):
        if by:
            most = min(most, max(0.0, (bound - np.sign(by) * at) / abs(by)))
    return most


def _next_trials(r: dict, evaluated: list, bound: float, tol: float) -> dict:
    """A segment's state after a scan: its best trial, and new trials along the step from there."""
    top = max(evaluated, key=lambda e: e["ll"])
    r["it"] += 1
    if top["ll"] > r["ll"]:
        r.update(a=top["a"], c=top["c"], ll=top["ll"])
        with np.errstate(all="ignore"):
            (da, dc), gain = _box_step(r["a"], r["c"], r["m"], r["s"], (top["g0"], top["g1"]), (top["h00"], top["h01"], top["h11"]), bound)
        if gain <= tol * r["n"]:
            # the last step is so short that the error after it, its square, is rounding
            r.update(a=r["a"] + da, c=r["c"] + dc, done=True, ok=True)
            return r
        r.update(da=da, dc=dc)
    else:                                   # no trial was better: rounding, or the model holds in a smaller region only
        r.update(da=r["da"] / 1024, dc=r["dc"] / 1024)
        if abs(r["da"]) + abs(r["dc"]) <= 1e-13 * (1 + abs(r["a"]) + abs(r["c"])):
            r.update(done=True, ok=True)
            return r
    most = _reach(r["a"], r["c"], r["da"], r["dc"], r["m"], r["s"], bound)
    steps = sorted({min(t, most) for t in TRIAL_STEPS})
    r["trials"] = [{"a": r["a"] + t * r["da"], "c": r["c"] + t * r["dc"]} for t in steps]
    return r


def logistic(df: DataFrame, target: str, feature: str, by: Sequence[str] | None = None,
             max_iter: int = 40, tol: float = 1e-14) -> DataFrame:
    """One-feature logistic regression per segment, parameters bounded to [-10, 10].

    Damped Newton: the step maximises the quadratic model over the box, so a zero step is a
    proof of the KKT conditions; a scan evaluates the likelihood and its derivatives at several
    lengths of that step at once, for all segments, and only a better point is taken. The feature is
    standardised inside. A fit ends when the step can gain no more than ``tol`` a row (``converged``).
    The raw rows stay where they are (``lookup_join``); a segment's state is one row.
    The two target values are mapped low -> 0, high -> 1.
    Output: ``by..., target, feature, n, intercept, coefficient, r_squared
    (McFadden, clipped to [0, 1]), log_loss, calibration_error, resid_std,
    iterations (scans), converged, status, y_low, y_high``. One class: parameters 0, status
    ``single_class``. A constant feature has coefficient 0.
    """
    _check_numeric(df, [target, feature])
    seg = by = as_list(by)
    base = df.select(*by, num(target).alias("_y0"), num(feature).alias("_x"))
    base = base.where(F.col("_y0").isNotNull() & F.col("_x").isNotNull())
    levels = materialize(base.groupBy(*seg).agg(F.min("_y0").alias("y_low"), F.max("_y0").alias("y_high"), F.count(F.lit(1)).alias("n"),
                                                F.avg("_x").alias("m"), F.stddev_pop("_x").alias("s")).where("n > 0"))
    levels = levels.withColumn("s", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0))
    n_seg = max(1, levels.count())
    data = lookup_join(base, levels.select(*seg, "y_high", "m", "s"), seg).select(
        *seg, F.when(F.col("_y0") == F.col("y_high"), 1.0).otherwise(0.0).alias("_y"), ((F.col("_x") - F.col("m")) / F.col("s")).alias("_u")
    ).persist()
    start = F.array(F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("c")))
    zero = {c: F.lit(0.0) for c in ("a", "c", "da", "dc")}
    state = levels.withColumns({**zero, "ll": F.lit(float("-inf")), "done": F.col("y_low") == F.col("y_high"), "ok": F.lit(False),
                                "it": F.lit(0), "trials": start}).drop("y_low", "y_high")
    state = materialize(state, n_seg)
    kinds = state.schema
    eta = F.col("p.a") + F.col("p.c") * F.col("_u")
    soft = F.greatest(F.lit(0.0), eta) + F.log1p(F.exp(-F.abs(eta)))
    prob = 1 / (1 + F.exp(-eta))
    wide = prob * (1 - prob)
    terms = (F.col("_y") * eta - soft, F.col("_y") - prob, (F.col("_y") - prob) * F.col("_u"), wide, wide * F.col("_u"), wide * F.col("_u") * F.col("_u"))

    def advance(batches):
        for b in batches:
            out = pa.schema([b.schema.field(c) for c in kinds.names])
            yield pa.RecordBatch.from_pylist([_next_trials(r, r.pop("points"), LOGISTIC_BOUND, tol) for r in b.to_pylist()], out)

    for _ in range(max_iter):
        active = state.where(~F.col("done"))
        rows = lookup_join(data, active.select(*seg, "trials"), seg)
        sums = (rows.select(*seg, "_y", "_u", F.explode("trials").alias("p")).groupBy(*seg, F.col("p.a").alias("a"), F.col("p.c").alias("c"))
                .agg(*[F.sum(e).alias(k) for k, e in zip(_SUMS, terms)]))
        points = sums.groupBy(*seg).agg(F.collect_list(F.struct("a", "c", *_SUMS)).alias("points"))
        moved = keyed_join(active, points, seg).mapInArrow(advance, kinds)
        state = materialize(state.where("done").unionByName(moved), n_seg)
        if state.where(~F.col("done")).isEmpty():
            break
    params = state.select(*seg, (F.col("a") - F.col("c") / F.col("s") * F.col("m")).alias("b0"), (F.col("c") / F.col("s")).alias("b1"),
                          "a", "c", "it", "ok")
    z = F.col("a") + F.col("c") * F.col("_u")
    p = 1 / (1 + F.exp(-z))
    pc = F.least(F.lit(1 - 1e-15), F.greatest(F.lit(1e-15), p))
    y = F.col("_y")
    ll = y * z - F.greatest(F.lit(0.0), z) - F.log1p(F.exp(-F.abs(z)))
    fin = materialize(lookup_join(data, params.select(*seg, "a", "c"), seg).groupBy(*seg).agg(
        F.sum(ll).alias("ll_model"),
        F.avg(y).alias("ybar"),
        (-F.avg(y * F.log(pc) + (1 - y) * F.log(1 - pc))).alias("log_loss"),
        F.avg(F.abs(p - y)).alias("calibration_error"),
        F.stddev_pop(y - p).alias("resid_std")), n_seg)
    data.unpersist(blocking=False)
    out = keyed_join(keyed_join(levels, params, seg), fin, seg, "left")
    ll_null = F.col("n") * (F.col("ybar") * F.log("ybar") + (1 - F.col("ybar")) * F.log(1 - F.col("ybar")))
    r2 = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("ll_model"), ll_null)))
    single = F.col("y_low") == F.col("y_high")
    return out.select(*by, F.lit(target).alias("target"), F.lit(feature).alias("feature"), "n",
                      F.col("b0").alias("intercept"), F.col("b1").alias("coefficient"),
                      r2.alias("r_squared"), "log_loss", "calibration_error", "resid_std",
                      F.col("it").alias("iterations"), (F.col("ok") & ~single).alias("converged"),
                      F.when(single, F.lit("single_class"))
                       .when(F.col("n") < MIN_ROWS_FOR_REGRESSION, F.lit("insufficient_rows"))
                       .otherwise(F.lit("ok")).alias("status"), "y_low", "y_high")


# --------------------------------------------------------------------------- encoding

def one_hot(df: DataFrame, max_cardinality: int = 10, drop_original: bool = True,
            cols: Sequence[str] | None = None) -> DataFrame:
    """Text columns with 2..``max_cardinality`` levels become ``<col>_<level>``
    0/1 doubles, first sorted level dropped; NULL gives all zeros.

    Level lists are bounded by ``max_cardinality`` (checked by an exact
    distinct count before any level reaches the driver).
    """
    cands = list(cols) if cols is not None else [c for c in df.columns if is_text(df, c)]
    if not cands:
        return df
    from ..functions.columns import distinct_counts
    counts = {r["column"]: r["n_distinct"] for r in distinct_counts(df, cands).collect()}
    chosen = [c for c in cands if 1 < counts.get(c, 0) <= max_cardinality]
    if not chosen:
        return df
    lv = df.agg(*[F.array_sort(F.collect_set(c)).alias(f"_l{i}") for i, c in enumerate(chosen)]).first()
    out = df
    for i, c in enumerate(chosen):
        for level in lv[f"_l{i}"][1:]:
            out = out.withColumn(f"{c}_{level}", F.when(F.col(c) == level, 1.0).otherwise(0.0))
        if drop_original:
            out = out.drop(c)
    return out
