"""Exact quantiles (linear interpolation, as pandas/numpy and DuckDB
``quantile_cont``) without holding a whole group in one task.

Spark's exact ``percentile`` aggregate keeps a value->count map per group and
merges it in a single task, which does not hold when one group carries a third
of a 100 TB table. Here each needed order statistic is found by distributed
selection:

1. per key: n, min, max (usually shared with the profile aggregate);
2. every needed rank starts in the bracket [min, max];
3. each round is ONE scan: rows are routed to the open bracket of their key,
   brackets still larger than ``collect_limit`` rows are split into buckets
   (only (bucket, count, min, max) is shuffled), the values of smaller brackets
   are counted and a running total finds the rank (no list of values is made,
   so that a task sorts rows, which spill);
4. a rank moves to the bucket that holds it; a bucket whose min equals its
   max resolves all its ranks at once (heavy ties resolve immediately).

The driver only loops over the tiny bracket table; rounds are few (a bucket
holds about 1/bins of its bracket), each round's bracket table is
checkpointed so a lost executor does not replay earlier rounds. The keys are
renamed meanwhile, so that they may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import keyed_join

BROADCAST_MAX_ROWS = 1_000_000
#: Buckets of a round, over all brackets.
MAX_BUCKETS = 4_000_000
#: Buckets of magnitude for a factor of e, and more than all magnitudes of doubles take.
SIZES_PER_E, MOST_SIZES = 4, 1 << 14


def _small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast an aggregated side only when its row count is proven small."""
    return F.broadcast(df) if max_rows <= BROADCAST_MAX_ROWS else df


def _single_pass(data: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Every group holds at most ``collect_limit`` values: sort each group once."""
    g = data.groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("_s"))
    n = F.size("_s")
    qs = []
    for p in probs:
        h = (n - 1) * F.lit(p)
        i = F.floor(h).cast("int")
        xi = F.element_at("_s", i + 1)
        xj = F.element_at("_s", F.least(i + 2, n))
        qs.append(xi + (h - i) * (xj - xi))
    return g.select(*keys, n.cast("long").alias("n"), F.array(*qs).alias("quantiles"))


def _magnitude(c: Column) -> Column:
    """A monotone map of the doubles onto [-1456, 1456]: sign times the log of the size above the least double."""
    size = F.ln(F.greatest(F.abs(c), F.lit(5e-324))) + F.lit(746.0)
    return F.when(c == 0, F.lit(0.0)).otherwise(F.signum(c) * size)


def _bucket(bins: int) -> Column:
    """The bucket of ``_v`` in its bracket [lo, hi]: one of ``bins`` equal parts of the range. While the bracket spans
    more than a decade the part next to zero is split by magnitude, so that values far below the greatest ones don't
    stay together for many rounds. The ends of a bracket never share a bucket, so every round splits it."""
    v, lo, hi = F.col("_v"), F.col("lo"), F.col("hi")
    zero = F.greatest(lo, F.least(hi, F.lit(0.0)))

    def part(x: Column) -> Column:
        share = F.coalesce(F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2), F.when(x == hi, F.lit(1.0)).otherwise(F.lit(0.0)))
        return F.least(F.lit(bins - 1), F.floor(share * bins).cast("int"))

    wide = (F.signum(lo) != F.signum(hi)) | (F.greatest(F.abs(lo), F.abs(hi)) / 10 > F.least(F.abs(lo), F.abs(hi)))
    size = F.when(wide & (part(v) == part(zero)), F.floor(_magnitude(v) * SIZES_PER_E).cast("int") + MOST_SIZES // 2).otherwise(F.lit(0))
    return F.when(hi == lo, F.lit(0).cast("long")).otherwise(part(v).cast("long") * MOST_SIZES + size)


def exact_quantiles(long_df: DataFrame, keys: Sequence[str], value: str = "value",
                    probs: Sequence[float] = (0.5,), *, stats: DataFrame | None = None,
                    bins: int = 4096, collect_limit: int = 50_000) -> DataFrame:
    """Return ``keys..., n, quantiles`` where ``quantiles[i]`` matches ``probs[i]``.

    ``stats`` (optional) must hold ``keys, n, vmin, vmax`` for the non-null values.
    """
    names = list(keys)
    keys = [f"_k{i}" for i in range(len(names))]
    probs = [float(p) for p in probs]

    def renamed(df: DataFrame, *more: Column | str) -> DataFrame:
        return df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, keys)], *more)

    def result(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(k).alias(c) for c, k in zip(names, keys)], "n", "quantiles")

    data = renamed(long_df, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if stats is None:
        stats = data.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("vmin"),
                                        F.max("_v").alias("vmax"))
    else:
        stats = renamed(stats, "n", "vmin", "vmax")
    stats = stats.where(F.col("n") > 0)
    summary = stats.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("max_n")).first()
    if not summary["k"]:
        return result(stats.select(*keys, "n", F.array().cast("array<double>").alias("quantiles")).limit(0))
    if summary["max_n"] <= collect_limit:
        return result(_single_pass(data, keys, probs))
    # upper bound of the bracket table: one bracket per needed rank
    max_brackets = summary["k"] * 2 * len(probs)

    targets = (stats.select(*keys, "n", "vmin", "vmax",
                            F.posexplode(F.array(*[F.lit(p) for p in probs])).alias("pid", "p"))
               .withColumn("h", (F.col("n") - 1) * F.col("p"))
               .withColumn("ri", F.floor("h").cast("long"))
               .withColumn("rj", F.least(F.col("ri") + 1, F.col("n") - 1))
               .withColumn("frac", F.col("h") - F.col("ri")))

    ranks = (targets.select(*keys, F.col("ri").alias("rank"), "vmin", "vmax", "n")
             .unionByName(targets.select(*keys, F.col("rj").alias("rank"), "vmin", "vmax", "n"))
             .distinct()
             .select(*keys, "rank", F.col("vmin").alias("lo"), F.col("vmax").alias("hi"),
                     F.lit(0).cast("long").alias("below"), F.col("n").alias("cnt"),
                     F.when(F.col("vmin") == F.col("vmax"), F.col("vmin")).alias("val")))
    ranks = materialize(ranks, max_brackets)
    w = (Window.partitionBy(*keys, "lo", "hi").orderBy("bucket", "mn")
         .rowsBetween(Window.unboundedPreceding, -1))

    while True:
        open_ranks = ranks.where(F.col("val").isNull())
        brackets = open_ranks.groupBy(*keys, "lo", "hi").agg((F.max("cnt") <= collect_limit).alias("_last"))
        kinds = {r["_last"]: r["count"] for r in brackets.groupBy("_last").count().collect()}
        if not kinds:
            break
        routed = keyed_join(data, _small(brackets, max_brackets), keys)
        routed = routed.where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
        # a bucket of a value of its own in the small brackets; the counts are a plain (codegen'd) aggregate without value lists
        width = max(16, min(bins, MAX_BUCKETS // kinds.get(False, 1)))
        hist = (routed.select(*keys, "lo", "hi", "_v", F.when(F.col("_last"), F.lit(0).cast("long")).otherwise(_bucket(width)).alias("bucket"),
                              F.when(F.col("_last"), F.col("_v")).alias("_own"))
                .groupBy(*keys, "lo", "hi", "bucket", "_own")
                .agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("mn"), F.max("_v").alias("mx")).drop("_own"))
        hist = hist.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)).cast("long"))

        joined = keyed_join(hist, _small(open_ranks.select(*keys, "rank", "lo", "hi", "below"), max_brackets), keys, extra=["lo", "hi"])
        start = F.col("below") + F.col("before")
        inside = (F.col("rank") >= start) & (F.col("rank") < start + F.col("c"))
        moved = joined.where(inside).select(
            *keys, "rank",
            F.col("mn").alias("lo"), F.col("mx").alias("hi"), start.alias("below"),
            F.col("c").alias("cnt"), F.when(F.col("mn") == F.col("mx"), F.col("mn")).alias("val"))
        ranks = materialize(ranks.where(F.col("val").isNotNull()).unionByName(moved), max_brackets)

    ri = ranks.select(*keys, F.col("rank").alias("ri"), F.col("val").alias("xi"))
    rj = ranks.select(*keys, F.col("rank").alias("rj"), F.col("val").alias("xj"))
    out = keyed_join(targets, ri, keys, "left", extra=["ri"])
    out = keyed_join(out, rj, keys, "left", extra=["rj"])
    out = out.withColumn("q", F.col("xi") + F.col("frac") * (F.col("xj") - F.col("xi")))
    return result(out.groupBy(*keys, "n")
                  .agg(F.array_sort(F.collect_list(F.struct("pid", "q"))).alias("_qs"))
                  .select(*keys, "n", F.transform("_qs", lambda s: s["q"]).alias("quantiles")))
