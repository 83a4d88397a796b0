"""F1, A25 - ``generate_report``: every diagnostic on one table, or on each of its segments, as DataFrames.

Shared work: ONE column-type aggregate, ONE long-form profile (moments and
exact quartiles/median/p95) feeding describe, IQR fences, distribution,
asymmetry and level checks; ONE pair aggregate for all correlations. Only
names of columns reach the driver, to choose which columns the next operators scan. The aggregated tables are
written down as they are made (``materialize``): rules read them, not their plans.

By segment the same jobs run with the segment among their keys, for any number of segments: what a column
is (numeric, identifier, grouping, temporal, two-valued) is a row per (segment, column) and joined, a rule's
ranking is a window over a segment's few candidates, and no segment's rows come together in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_list, is_numeric, is_text, long_numeric
from ..functions.joins import keyed_join
from ..operators import findings as FD
from ..operators.anova import confounders_for_pairs, segment_rates, significant_subgroups
from ..operators.association import correlation_pvalues, top_pairs
from ..operators.derived import derived_pairs
from ..operators.distribution import count_data_flag, heavy_tail_flag, zero_inflation_flag
from ..operators.influence import influential_points
from ..operators.profile import column_profile
from ..operators.quality import validate_dataset
from ..operators.schema import column_types, temporal_flags
from ..operators.segments import MIN_GROUP_SIZE, eligible_segments
from ..operators.shape import nonlinearity_scan
from ..operators.whatif import cross_validation, plausible_bounds, scenario_table, simulate
from ..session import materialize

ASYM_TOP = 3


def segment_reports(df: DataFrame, group_by: str | Sequence[str], target: str | None = None, feature: str | None = None,
                    min_group_size: int = MIN_GROUP_SIZE, **options) -> dict[str, DataFrame]:
    """:func:`generate_report` of every segment with at least ``min_group_size`` rows, in the same jobs.

    Each table begins with ``segment`` (the key's parts joined by "_") and a copy ``by_<column>`` of each key. Rows with a
    null in a key are in no segment. The key columns are columns of the segments too, as constants.
    """
    group_by = as_list(group_by)
    by = [f"by_{c}" for c in group_by]
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in group_by)).withColumns({b: F.col(f"`{c}`") for b, c in zip(by, group_by)})
    out = generate_report(eligible_segments(rows, by, min_group_size), target, feature, by=by, **options)
    name = F.concat_ws("_", *[F.col(f"`{b}`").cast("string") for b in by]).alias("segment")
    return {k: v.select(name, *v.columns) for k, v in out.items()}


def generate_report(df: DataFrame, target: str | None = None, feature: str | None = None,
                    change_pct: float | None = None, baseline_feature_value: float | None = None,
                    bounds: tuple[float, float] | None = None, iqr_k: float = 1.5,
                    key_cols: Sequence[str] | None = None,
                    persist_input: bool = False, by: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """All diagnostics of one table: every numeric column, every pair, every text column.

    ``by``: key columns of segments; every table then begins with them and holds a report of each segment. The keys
    themselves aren't analysed (:func:`segment_reports` adds copies for that).
    The report scans its input about thirty times; ``persist_input=True`` keeps the input
    (MEMORY_AND_DISK) for a source that is costly to read again."""
    spark = df.sparkSession
    by = as_list(by)
    kinds = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by)
    import os
    import time
    t0 = [time.time()]

    def mark(label: str) -> None:  # VARSCOPE_TRACE=1 prints the build time per section
        if os.environ.get("VARSCOPE_TRACE"):
            now = time.time()
            print(f"[report] {label}: {now - t0[0]:.1f}s", flush=True)
            t0[0] = now

    def find(rows: DataFrame, *rule) -> None:
        parts.append(FD.finding(rows, *rule, by=by))

    def first(rows: DataFrame, k: int, *order) -> DataFrame:
        """The first ``k`` rows of each segment; the rows are aggregates of a segment's columns."""
        if not by:
            return rows.orderBy(*order).limit(k)
        return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")

    def within(rows: DataFrame, flags: DataFrame, *columns: str, how: str = "left_semi") -> DataFrame:
        """Rows each of whose ``columns`` is among the segment's flagged columns."""
        for c in columns:
            rows = keyed_join(rows, flags.select(*by, F.col("column").alias("_c")).withColumnRenamed("_c", c), by + [c], how)
        return rows

    def small(rows: DataFrame) -> DataFrame:
        """An aggregated table, written down; of one segment it is a matter of the columns alone and one partition."""
        return materialize(rows, None if by else 1)

    if persist_input:
        from pyspark import StorageLevel
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if iqr_k <= 0:
        raise ValueError("iqr_k must be strictly positive")
    types = small(column_types(df, by=by))
    columns = [c for c in df.columns if c not in by]
    # names of columns that are numeric and no identifier in some segment
    legitimate = types.where(F.col("column").isin(*[c for c in columns if is_numeric(df, c)]) & ~F.col("is_identifier")).select(*by, "column")
    some = {r["column"] for r in legitimate.select("column").distinct().collect()}
    numeric = [c for c in columns if c in some]
    texts = [c for c in columns if is_text(df, c)]
    levels = types.select(*by, "column", "n_distinct")
    temporal = temporal_flags(df, types, by)
    only = {r["column"]: r["n_distinct"] for r in levels.collect()} if not by else None
    mark("types")
    out: dict[str, DataFrame] = {"column_types": types}
    parts: list[DataFrame] = []

    if by:
        validation = small(validate_dataset(df, by=by, types=types))
    else:
        validation = small(validate_dataset(df, [r["column"] for r in types.where("is_identifier").collect()]))
    out["validation"] = validation
    find(validation.where(F.col("n_rows") < FD.SMALL_SAMPLE_THRESHOLD), "SMALL_SAMPLE",
         F.when(F.col("n_rows") < 15, "high").otherwise("medium"), "quality", F.array(), F.col("n_rows"))
    n_numeric = keyed_join(validation.select(*by, "n_rows"), legitimate.groupBy(*by).agg(F.count(F.lit(1)).alias("k")), by, "left") \
        .withColumn("k", F.coalesce("k", F.lit(0)))
    find(n_numeric.where("k = 0"), "NO_NUMERIC", "high", "quality", F.array())
    # all columns are compared all the same
    find(n_numeric.where(F.col("k") > FD.WIDE_TABLE_COLUMNS), "WIDE_TABLE", "low", "correlation", F.array(), F.col("k"))

    mark("validation")
    if numeric:
        prof = small(within(
            keyed_join(column_profile(df, numeric, by, probs=(0.25, 0.5, 0.75, 0.95), with_distinct=False).drop("n_distinct"),
                       levels, [*by, "column"], "left"), legitimate, "column"))
        out["profile"] = prof
        # IQR fences from the shared quartiles; one pass counts the outliers.
        q1, q3 = F.col("quantiles")[0], F.col("quantiles")[2]
        bounds_df = prof.select(*by, "column", "n", (q1 - iqr_k * (q3 - q1)).alias("lower_bound"),
                                (q3 + iqr_k * (q3 - q1)).alias("upper_bound"))
        flagged = (keyed_join(long_numeric(df, numeric, by), bounds_df.drop("n"), [*by, "column"])
                   .where((F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound")))
                   .groupBy(*by, "column").agg(F.count(F.lit(1)).alias("n_outliers")))
        n_rows = validation.select(*by, "n_rows")
        anomalies = (keyed_join(bounds_df, flagged, [*by, "column"], "left")
                     .withColumn("n_outliers", F.coalesce("n_outliers", F.lit(0)))
                     .transform(lambda d: keyed_join(d, n_rows, by))
                     .where((F.col("n_outliers") > 0) & (F.col("n_rows") >= FD.SMALL_SAMPLE_THRESHOLD))).cache()
        out["anomalies"] = anomalies
        every_anomaly = anomalies.groupBy(*by).agg(F.array_sort(F.collect_list("column")).alias("columns"), F.sum("n_outliers").alias("total"))
        find(every_anomaly.where(F.size("columns") > 0), "ANOMALY", "medium", "quality",
                                F.col("columns"), F.col("total"))

        dist = (prof.withColumn("median", F.col("quantiles")[1]).withColumn("p95", F.col("quantiles")[3])
                .withColumn("tail_ratio", F.when(F.col("median") > 0, F.col("p95") / F.col("median")).otherwise(0.0))
                .withColumn("is_count", F.coalesce(count_data_flag(), F.lit(False)))
                .withColumn("is_zero", F.coalesce(zero_inflation_flag(), F.lit(False)))
                .withColumn("is_heavy", F.coalesce(heavy_tail_flag(), F.lit(False)))
                .withColumn("asymmetry", F.when(F.col("std") > 0, F.abs(F.col("mean") - F.col("median")) / F.col("std")))
                ).cache()
        out["distribution"] = dist
        flagged_n = dist.groupBy(*by).agg(F.count(F.when(F.col("is_count") | F.col("is_zero") | F.col("is_heavy"), 1)).alias("k"))
        many = F.col("k") > FD.DISTRIBUTION_SUMMARY_COLUMNS
        single = keyed_join(dist, flagged_n, by).where(~many)          # the summary replaces the single rows
        find(single.where("is_count"), "DISTRIBUTION_COUNT", "medium", "distribution",
                                F.array("column"), F.col("mean"))
        find(single.where("is_zero AND NOT is_count"), "DISTRIBUTION_ZERO", "medium", "distribution",
                                F.array("column"), F.col("zero_ratio"))
        find(single.where("is_heavy"), "DISTRIBUTION_HEAVY", "medium", "distribution",
                                F.array("column"), F.col("tail_ratio"))
        find(flagged_n.where(many), "DISTRIBUTION_SUMMARY", "medium", "distribution",
                                F.array(), F.col("k"))
        scope = [c for c in (target, feature) if c] or None
        asym = dist.where(~F.col("is_count") & ~F.col("is_zero") & (F.col("asymmetry") > 0.4))
        if scope:
            asym = asym.where(F.col("column").isin(*scope))
        else:
            asym = first(asym, ASYM_TOP, F.col("asymmetry").desc(), "column")
        asym = asym.cache()
        find(asym, "ASYMMETRY", "low", "distribution", F.array("column"), F.col("asymmetry"))

    mark("profile/anomalies/distribution")
    best, signal = None, FD.empty_findings(spark, kinds)
    if texts and numeric:
        sub = significant_subgroups(df, [target] if target in numeric else numeric, by=by, level_counts=only,
                                    segment_levels=levels if by else None)
        if target not in numeric or by:
            sub = within(sub, legitimate, "target")
        sub = small(sub)
        out["subgroups"] = sub
        find(sub.where("deterministic"), "DETERMINISTIC", "medium", "correlation",
                                F.array("group_col", "target"), F.col("eta_squared"))
        best = small(first(sub.where(~F.col("deterministic")).groupBy(*by, "group_col")
                     .agg(F.max_by(F.struct("eta_squared", "target"), F.struct("eta_squared", "target")).alias("b"))
                     .select(*by, "group_col", "b.*"), 5, F.col("eta_squared").desc(), "group_col"))
        sev = F.when(F.col("eta_squared") >= 0.7, "high").otherwise("medium")
        code = F.when(F.col("eta_squared") >= 0.5, F.lit("SUBGROUP_DOMINANT_STRONG")).otherwise(F.lit("SUBGROUP_DOMINANT"))
        seasonal = temporal.withColumnRenamed("column", "group_col")
        find(keyed_join(best, seasonal, [*by, "group_col"], "left_anti"), code, sev, "correlation", F.array("group_col", "target"),
                                F.col("eta_squared"))
        find(keyed_join(best, seasonal, [*by, "group_col"], "left_semi"), "SAISONNALITE", sev, "saisonnalite",
                                F.array("group_col", "target"), F.col("eta_squared"))
        # asymmetric columns: one hint at the strongest subgroup
        strongest = first(best, 1, F.col("eta_squared").desc(), "group_col")
        hint = keyed_join(strongest, asym.groupBy(*by).agg(F.count(F.lit(1)).alias("n_asymmetric")), by).where("n_asymmetric > 0")
        find(hint, "ASYMMETRY_SUBGROUP", "low", "distribution", F.array("group_col"), F.col("n_asymmetric"))
        binary = keyed_join(types.where("role = 'boolean'").select(*by, "column", "position"), legitimate, [*by, "column"], "left_semi")
        binary = binary.where(F.col("column") == target) if target else first(binary, 1, "position")
        rated = sorted(r["column"] for r in binary.select("column").distinct().collect())      # names of columns
        if rated:
            rates = [segment_rates(df, c, [g for g in texts if g != c], by, segment_levels=levels).withColumn("target", F.lit(c)) for c in rated]
            rates = keyed_join(reduce(DataFrame.unionByName, rates), binary.select(*by, F.col("column").alias("target")), [*by, "target"], "left_semi").cache()
            out["segment_rates"] = rates
            find(rates.where(F.col("rank") == 1), "SEGMENT_RATE", "low", "segments", F.array("group_col", "target"), F.col("rate"))

    mark("subgroups")
    if len(numeric) >= 2:
        pairs = small(correlation_pvalues(df, numeric, by, among=legitimate))
        derived = small(derived_pairs(df, numeric, by, among=legitimate))
        out["correlations"] = pairs
        out["derived_pairs"] = derived
        every_derived = derived.groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("column_a", "column_b"))))).alias("columns"),
                                    F.count(F.lit(1)).alias("k"))
        find(every_derived.where("k > 0"), "DERIVED", "low", "correlation", F.col("columns"), F.col("k"))
        listed = derived.select(*by, F.col("column_a").alias("_lo"), F.col("column_b").alias("_hi"))
        kept = keyed_join(pairs.withColumn("_lo", F.least("column_a", "column_b")).withColumn("_hi", F.greatest("column_a", "column_b")),
                          listed, [*by, "_lo", "_hi"], "left_anti").drop("_lo", "_hi")
        mt = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("significant"), 1)).alias("s")).cache()
        find(mt.where((F.col("m") >= 6) & (F.col("s") < F.col("m"))), "MULTIPLE_TESTING",
                                "medium", "correlation", F.array(), F.col("m").cast("double"))
        top = small(top_pairs(pairs, 5, by, exclude=derived))
        out["top_pairs"] = top
        # no finding, but what the main insight falls back on
        signal = FD.finding(top.where("significant"), "TOP_PAIR", "low", "correlation", F.array("column_a", "column_b"), F.abs("r"), by=by)
        mark("pairs/derived/confounders")
        strongest_pair = first(kept.where(F.col("significant") & (F.abs("r") >= 0.6)), 1, F.abs("r").desc(), "idx_a", "idx_b")
        when = temporal.groupBy(*by).agg(F.array_sort(F.collect_list("column")).alias("_when"))
        find(keyed_join(strongest_pair, when, by).where(F.size("_when") > 0), "SEASONAL_RISK", "medium", "saisonnalite", F.col("_when"), F.abs("r"))
        # non-linearity: scenario pair first, then every tested pair in one direction (a -> b)
        # (untested pairs - fewer than 10 complete rows or a constant side - drop out inside the scan)
        pair_list = [(target, feature)] if target and feature else []
        pair_list += [(b, a) for i, a in enumerate(numeric) for b in numeric[i + 1:]]
        seen, nl_pairs = set(), []
        for p in pair_list:
            if p not in seen:
                seen.add(p)
                nl_pairs.append(p)
        # A13 for every candidate pair in ONE grouped ANOVA job: the top-3 pairs give the
        # CONFOUNDER findings, and pairs whose confounder is also a strong subgroup
        # (eta^2 > 0.5) are left out of the non-linearity scan.
        conf_all = small(within(confounders_for_pairs(df, nl_pairs, by=by, level_counts=only, segment_levels=levels if by else None),
                                      legitimate, "target", "feature"))
        top3 = top.where(F.col("rank") <= 3).select(*by, F.col("column_b").alias("target"),
                                                     F.col("column_a").alias("feature"))
        conf = keyed_join(conf_all, top3, [*by, "target", "feature"], "left_semi")
        out["confounders"] = conf
        by_pair = conf.groupBy(*by, "target", "feature").agg(F.array_sort(F.collect_set("column")).alias("columns"),
                                                        F.max("eta_target").alias("eta_target"))
        find(by_pair, "CONFOUNDER", "high", "correlation",
                                F.concat(F.array("feature", "target"), F.col("columns")), F.col("eta_target"))
        # pairs that one column derives from another are no news: not scanned
        d = derived.select(*by, F.col("column_a").alias("target"), F.col("column_b").alias("feature"))
        exclude = d.unionByName(d.select(*by, F.col("feature").alias("target"), F.col("target").alias("feature")))
        if best is not None:
            strong_sub = best.where(F.col("eta_squared") > 0.5).select(*by, F.col("group_col").alias("column"))
            exclude = exclude.unionByName(keyed_join(conf_all, strong_sub, [*by, "column"], "left_semi").select(*by, "target", "feature"))
        nl = small(nonlinearity_scan(df, nl_pairs, by, exclude=small(exclude), among=legitimate))
        out["nonlinearity"] = nl
        if target and feature:
            find(nl.where("shown").where(F.col("feature") == feature), "SCENARIO_NONLINEAR", "medium",
                                    "simulation", F.array("feature", "target"), F.col("gain"))
        find(nl.where("shown"), F.when(F.col("kind") == "quadratic", F.lit("NONLINEAR_QUAD"))
                                .otherwise(F.lit("NONLINEAR_STEP")), "medium", "non_linearity",
                                F.array("feature", "target"), F.col("gain"))

    mark("nonlinearity")
    r2_col, act_col = F.lit(None).cast("double"), F.lit(None).cast("boolean")
    sim = None
    if target and feature and change_pct is not None:
        sc = scenario_table(spark, [change_pct], baseline_feature_value, bounds)
        from ..operators.regression import simple_fit_stats
        fs = simple_fit_stats(df, target, feature, by).cache()      # shared by simulation, CV and Cook
        prof_ok = not by and "profile" in out and feature in numeric
        if not by:
            sim = simulate(df, target, feature, sc, binary=only.get(target) == 2, fit_stats=fs,
                           profile=out["profile"] if prof_ok else None).cache()
        else:                                            # each segment decides which model it takes
            two = levels.where((F.col("column") == target) & (F.col("n_distinct") == 2)).select(*by)
            sim = keyed_join(simulate(df, target, feature, sc, by, binary=False, fit_stats=fs), two, by, "left_anti")
            if two.limit(1).count():
                sim = sim.unionByName(simulate(keyed_join(df, two, by, "left_semi"), target, feature, sc, by, binary=True))
            sim = small(sim)
        out["simulation"] = sim
        if key_cols:
            out["cross_validation"] = cross_validation(df, target, feature, by, key_cols=key_cols, fit_stats=fs)
        find(sim.where(F.col("non_actionable_reason") == "low_r2"),
                                "SIMULATION_NON_ACTIONABLE_R2", "high", "simulation",
                                F.array(F.lit(feature), F.lit(target)), F.col("r_squared"))
        find(sim.where(F.col("non_actionable_reason") == "level_feature"),
                                "SIMULATION_PALIERS", "high", "simulation",
                                F.array(F.lit(feature), F.lit(target)), F.col("r_squared"))
        find(sim.where(F.col("actionable") & (F.col("r_squared") < 0.05)), "SIMULATION_LOW_R2",
                                "medium", "simulation", F.array(F.lit(feature), F.lit(target)), F.col("r_squared"))
        find(sim.where(F.col("r_squared") < FD.LOW_R_SQUARED_THRESHOLD), "LOW_R2", "medium",
                                "simulation", F.array(F.lit(feature), F.lit(target)), F.col("r_squared"))
        eff = keyed_join(sim.select(*by, "n"), validation.select(*by, "n_rows"), by)
        find(eff.where((F.col("n") < F.col("n_rows")) & (F.col("n") < FD.SMALL_SAMPLE_THRESHOLD)),
                                "EFFECTIVE_SAMPLE", "medium", "simulation", F.array(F.lit(feature), F.lit(target)),
                                F.col("n").cast("double"))
        if key_cols:
            _, infl = influential_points(df, feature, target, key_cols, by, fit_stats=fs)
            infl = infl.cache()
            out["influence"] = infl
            find(infl.where(F.col("n_influential") > 0), "INFLUENTIAL", "medium", "simulation",
                                    F.array(F.lit(feature), F.lit(target)), F.col("max_distance"))
        lim = plausible_bounds(target)
        if lim:
            find(sim.where((F.col("simulated") < lim[0]) | (F.col("simulated") > lim[1])),
                                    "OUT_OF_RANGE", "medium", "simulation", F.array(F.lit(target)), F.col("simulated"))
        r2_col, act_col = F.col("r_squared"), F.col("actionable")

    mark("simulation")
    # the rule union spans every operator's plan: evaluate it once and cut the lineage,
    # so de-duplication, score and main insight work on a small table
    findings = FD.dedupe_codes(small(FD.union_findings(spark, parts, kinds)), by=by).cache()
    out["findings"] = findings
    counts = findings.groupBy(*by).agg(F.count(F.lit(1)).alias("n_findings"))
    base = keyed_join(validation.select(*by, "n_rows"), counts, by, "left")
    if "anomalies" in out:
        base = keyed_join(base, out["anomalies"].groupBy(*by).agg(F.count(F.lit(1)).alias("n_anomaly_cols")), by, "left")
    else:
        base = base.withColumn("n_anomaly_cols", F.lit(0))
    base = base.fillna(0, ["n_findings", "n_anomaly_cols"])
    if sim is not None:
        base = keyed_join(base, sim.select(*by, "r_squared", "actionable"), by, "left")
    s, level = FD.score(F.col("n_rows"), F.col("n_findings"), F.col("n_anomaly_cols"), r2_col, act_col)
    out["score"] = base.select(*by, "n_rows", "n_findings", "n_anomaly_cols", s.alias("score"), level.alias("level"))
    out["main_insight"] = FD.main_insight(findings.unionByName(signal), [c for c in (target, feature) if c], by)
    mark("findings")
    return out
