"""Q1-Q4, R8, R9 - percent-change what-if projections over a fitted model.

A *scenario table* (one row per scenario) is joined to the per-segment fits,
so a grid of scenarios x segments is one small job after the fit aggregates.
Interval (R8) and cross-validation (R9) come from closed-form sums, no extra
model fits over the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_list, num
from ..functions.joins import keyed_join, lookup_join
from .levels import level_feature_for_simulation
from .regression import _check_numeric, is_two_valued, logistic, ols_from_stats, simple_fit_stats

NEAR_ZERO_BASELINE_RATIO = 0.1
INTERVAL_Z = 1.28
N_FOLDS = 5
MIN_ROWS_FOR_CV = 20

SCENARIO_SCHEMA = T.StructType([
    T.StructField("scenario_id", T.LongType()),
    T.StructField("change_pct", T.DoubleType()),
    T.StructField("baseline_feature_value", T.DoubleType()),
    T.StructField("bound_min", T.DoubleType()),
    T.StructField("bound_max", T.DoubleType()),
])


def scenario_table(spark, change_pcts: Sequence[float], baseline_feature_value: float | None = None,
                   bounds: tuple[float, float] | None = None) -> DataFrame:
    if bounds is not None and bounds[0] > bounds[1]:
        raise ValueError("bounds must satisfy min <= max")
    rows = [(i, float(p), baseline_feature_value, *(bounds or (None, None))) for i, p in enumerate(change_pcts)]
    return spark.createDataFrame(rows, SCENARIO_SCHEMA)


def _grid(fits: DataFrame, scenarios: DataFrame, by: list[str]) -> DataFrame:
    """Every fitted segment x every scenario (the grid is the result itself).
    The scenario table is user-sized, so it is the broadcast side."""
    one = F.lit(1).alias("_one")
    return fits.select("*", one).join(F.broadcast(scenarios.select("*", one)), "_one").drop("_one")


def simulate(df: DataFrame, target: str, feature: str, scenarios: DataFrame,
             by: Sequence[str] | None = None, with_levels: bool = True,
             binary: bool | None = None, fit_stats: DataFrame | None = None,
             profile: DataFrame | None = None) -> DataFrame:
    """``by..., scenario_id, change_pct, model_type, r_squared,
    reference_value, baseline, simulated, bounds_applied, change_pct_result,
    change_pct_reliable, change_absolute, change_percentage_points, actionable,
    non_actionable_reason, interval_lower, interval_upper``."""
    _check_numeric(df, [target, feature])
    by = as_list(by)
    if binary is None:  # decided on the whole target column, as the reference does
        binary = is_two_valued(df, target)
    margins = df.groupBy(*by).agg(F.avg(num(feature)).alias("feature_mean"),
                                  F.stddev_samp(num(target)).alias("target_std"))
    if binary:
        lg = logistic(df, target, feature, by)
        fits = lg.select(*by, F.lit("logistic").alias("model_type"), "r_squared",
                         F.col("intercept").alias("a"), F.col("coefficient").alias("b"), "resid_std", "n")
    else:
        st = ols_from_stats(fit_stats if fit_stats is not None else simple_fit_stats(df, target, feature, by))
        fits = st.select(*by, F.lit("linear").alias("model_type"), "r_squared",
                         F.col("intercept").alias("a"), F.col("slope").alias("b"), "resid_std", "n")
    fits = keyed_join(fits, margins, by, "left")
    if with_levels:
        lv = level_feature_for_simulation(df, feature, target, by, profile=profile).select(*by, "is_level_feature")
        fits = keyed_join(fits, lv, by, "left")
    else:
        fits = fits.withColumn("is_level_feature", F.lit(False))
    g = _grid(fits, scenarios, by)
    is_log = F.col("model_type") == "logistic"

    def predict(xv):
        z = F.col("a") + F.col("b") * xv
        zc = F.least(F.lit(500.0), F.greatest(F.lit(-500.0), z))
        return F.when(is_log, 1 / (1 + F.exp(-zc))).otherwise(z)

    ref = F.coalesce(F.col("baseline_feature_value"), F.col("feature_mean"))
    g = g.withColumn("reference_value", ref)
    g = g.withColumn("baseline", predict(F.col("reference_value")))
    raw = predict(F.col("reference_value") * (1 + F.col("change_pct")))
    has_b = F.col("bound_min").isNotNull() & F.col("bound_max").isNotNull()
    g = g.withColumn("bounds_applied", F.when(has_b, ~((raw >= F.col("bound_min")) & (raw <= F.col("bound_max")))))
    g = g.withColumn("simulated", F.when(has_b, F.greatest("bound_min", F.least("bound_max", raw))).otherwise(raw))
    reliable = ~is_log & ((F.col("target_std") == 0) |
                          (F.abs("baseline") >= NEAR_ZERO_BASELINE_RATIO * F.col("target_std")))
    g = g.withColumn("change_pct_reliable", F.coalesce(reliable, F.lit(False)))
    g = g.withColumn("change_pct_result", F.when(F.col("change_pct_reliable"),
                                                 F.try_divide(F.col("simulated") - F.col("baseline"), F.col("baseline")) * 100))
    g = g.withColumn("change_absolute", F.col("simulated") - F.col("baseline"))
    g = g.withColumn("change_percentage_points", F.when(is_log, F.col("change_absolute") * 100))
    g = g.withColumn("non_actionable_reason",
                     F.when(F.col("r_squared") < 0.01, F.lit("low_r2"))
                      .when(F.coalesce(F.col("is_level_feature"), F.lit(False)), F.lit("level_feature")))
    g = g.withColumn("actionable", F.col("non_actionable_reason").isNull())
    delta = INTERVAL_Z * F.col("resid_std")
    lo, hi = F.col("simulated") - delta, F.col("simulated") + delta
    lo = F.when(is_log, F.least(F.lit(1.0), F.greatest(F.lit(0.0), lo))).when(has_b, F.greatest(F.col("bound_min"), lo)).otherwise(lo)
    hi = F.when(is_log, F.least(F.lit(1.0), F.greatest(F.lit(0.0), hi))).when(has_b, F.least(F.col("bound_max"), hi)).otherwise(hi)
    g = g.withColumn("interval_lower", lo).withColumn("interval_upper", hi)
    return g.select(*by, "scenario_id", "change_pct", F.lit(target).alias("target"), F.lit(feature).alias("feature"),
                    "model_type", "r_squared", "n", "reference_value", "baseline", "simulated", "bounds_applied",
                    "change_pct_result", "change_pct_reliable", "change_absolute", "change_percentage_points",
                    "actionable", "non_actionable_reason", "interval_lower", "interval_upper")


def fold_of(cols: Sequence[str], n_folds: int = N_FOLDS):
    """Deterministic fold id from row content (stable under task retries)."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(n_folds))


def cross_validation(df: DataFrame, target: str, feature: str, by: Sequence[str] | None = None,
                     fold_col: str | None = None, key_cols: Sequence[str] | None = None,
                     n_folds: int = N_FOLDS, fit_stats: DataFrame | None = None) -> DataFrame:
    """K-fold test R^2 of the linear fit from per-fold centred sums.

    Train sums = segment total - fold sums; test residuals are expanded from
    the fold's own sums, so each fold costs no pass over the data. MAE/RMSE
    are of the full-data model on all rows (named ``train_mae``/``train_rmse``).
    Folds come from ``fold_col`` or a hash of ``key_cols``, one of which must be given: a hash of
    the values would put equal rows into one fold. Segments with fewer than 20 complete rows get NULL,
    and so does the test R^2 of a segment whose rows are all in one fold.
    """
    if not fold_col and not as_list(key_cols):
        raise ValueError("cross_validation needs fold_col or key_cols")
    _check_numeric(df, [target, feature])
    by = as_list(by)
    fit = ols_from_stats(fit_stats if fit_stats is not None else simple_fit_stats(df, target, feature, by)).select(
        *by, "n", "mean_x", "mean_y", "slope", "intercept")
    rows = df.select(*by, num(feature).alias("x"), num(target).alias("y"),
                     *([F.col(fold_col).alias("_fold")] if fold_col else []),
                     *[F.col(k).alias(f"_k{i}") for i, k in enumerate(as_list(key_cols))])
    rows = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    if not fold_col:
        rows = rows.withColumn("_fold", fold_of([f"_k{i}" for i in range(len(as_list(key_cols)))], n_folds))
    j = lookup_join(rows, fit, by)
    xc, yc = F.col("x") - F.col("mean_x"), F.col("y") - F.col("mean_y")
    err = F.col("y") - (F.col("intercept") + F.col("slope") * F.col("x"))
    folds = j.groupBy(*by, "_fold").agg(
        F.count(F.lit(1)).alias("m"), F.sum(xc).alias("sx"), F.sum(yc).alias("sy"),
        F.sum(xc * xc).alias("sxx"), F.sum(yc * yc).alias("syy"), F.sum(xc * yc).alias("sxy"),
        F.sum(F.abs(err)).alias("sabs"), F.sum(err * err).alias("ssq"))
    tot = folds.groupBy(*by).agg(*[F.sum(c).alias(f"t_{c}") for c in ("m", "sx", "sy", "sxx", "syy", "sxy",
                                                                       "sabs", "ssq")])
    f = keyed_join(folds, tot, by)
    tm = F.col("t_m") - F.col("m")
    tsx, tsy = F.col("t_sx") - F.col("sx"), F.col("t_sy") - F.col("sy")
    tsxx, tsxy = F.col("t_sxx") - F.col("sxx"), F.col("t_sxy") - F.col("sxy")
    mx, my = F.try_divide(tsx, tm), F.try_divide(tsy, tm)
    cxx = tsxx - tm * mx * mx
    cxy = tsxy - tm * mx * my
    b = F.try_divide(cxy, cxx)
    a = my - b * mx
    m = F.col("m")
    ss_res = (F.col("syy") - 2 * a * F.col("sy") - 2 * b * F.col("sxy") + m * a * a
              + 2 * a * b * F.col("sx") + b * b * F.col("sxx"))
    ss_tot = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), m)
    r2 = F.when(ss_tot > 0, 1 - F.try_divide(ss_res, ss_tot)).otherwise(F.lit(0.0))
    usable = (tm >= 3) & (m >= 2) & (cxx > 0)
    per = f.withColumn("r2", F.when(usable, r2))
    out = per.groupBy(*by).agg(
        F.first("t_m").alias("n"), F.avg("r2").alias("_cv"), F.count("r2").alias("folds_used"),
        (F.first("t_sabs") / F.first("t_m")).alias("train_mae"),
        F.sqrt(F.first("t_ssq") / F.first("t_m")).alias("train_rmse"))
    enough = F.col("n") >= MIN_ROWS_FOR_CV
    return out.select(*by, "n", F.when(enough & (F.col("folds_used") > 0), F.greatest(F.lit(0.0), F.col("_cv")))
                      .alias("cv_r2_mean"), F.when(enough, F.col("folds_used")).alias("folds_used"),
                      F.when(enough, F.col("train_mae")).alias("train_mae"),
                      F.when(enough, F.col("train_rmse")).alias("train_rmse"))


# Plausible ranges inferred from the target's name (Q4).
# name contains "note" and "20" -> [0, 20]; "pourcent", "pct" or "taux" -> [0, 100];
# "proba", or the name equals "churn" -> [0, 1].
def plausible_bounds(target: str) -> tuple[float, float] | None:
    low = target.lower()
    if "note" in low and "20" in low:
        return (0.0, 20.0)
    if "pourcent" in low or "pct" in low or "taux" in low:
        return (0.0, 100.0)
    if "proba" in low or low == "churn":
        return (0.0, 1.0)
    return None
