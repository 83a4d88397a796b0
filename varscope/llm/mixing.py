"""Mixing sources to target weights, in DataFrame operations only.

Efraimidis-Spirakis sampling without replacement: each document draws a key
``-ln(u) / quality`` from a hash of its id, the smallest keys are taken first, and a
prefix sum of sizes over the keys decides where the token budget of its source ends.
A source whose target is above its size first gives complete epochs; only the rest of
the target is sampled. Documents are taken whole; the one in which the budget ends is
taken if that brings the source nearer to its target.

The order by key is never one task's work. Keys are cut into two digits of
:data:`FANOUT`, the first of the key's logarithm, the second of its place between that
digit's ends; sizes are summed by (source, digit), the digit that holds the end of the
budget is found from at most ``FANOUT`` rows a source, then the same is done inside it.
Only documents of that one cell are sorted by key. A quality weight moves the logarithm and
leaves its spread, so whatever the weights a first digit holds at most about 2 % of the keys
and a cell 1 / ``FANOUT`` of that.

Defined results: null text has size 0; a null source is a source of its own, ranked last;
documents of size 0 take 0; rows with equal key, size and text are all in or all out, so equal
rows are interchangeable; an empty table gives an empty table; a null id draws the key of
an empty string, and rows without an id follow each other by size and a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

WORDS = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
FANOUT = 1000
#: Logarithms of keys that first digits tell apart; what lies beyond is in the first or the last.
LOGS = (-40.0, 10.0)


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDS)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """At most 1, at least 0.05: shrinks with the runs of symbols per word."""
    return F.greatest(F.lit(1.0) - F.regexp_count(text, F.lit(SYMBOLS)) / F.greatest(size, F.lit(1)).cast("double"),
                      F.lit(0.05))


def uniform(key: Column) -> Column:
    """In (0, 1), from 52 bits of md5 of the key, the same in every run."""
    bits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def with_keys(docs: DataFrame, id_col: str, text: str, source: str, quality: Column | None) -> DataFrame:
    """``docs`` and its columns ``_source``, ``_size``, ``_place``: the place in its source's order."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_source", F.col(source).cast("string")).withColumn("_size", words(body))
    q = quality if quality is not None else quality_weight(body, F.col("_size"))
    key = -F.ln(uniform(F.col(id_col))) / q
    digit = lambda share: F.greatest(F.lit(0), F.least(F.lit(FANOUT - 1), F.floor(share * FANOUT))).cast("int")
    lo, wide = LOGS[0], (LOGS[1] - LOGS[0]) / FANOUT
    df = df.withColumn("_key", key).withColumn("_d", digit((F.ln("_key") - lo) / (LOGS[1] - lo)))
    start, end = F.exp(lo + F.col("_d") * wide), F.exp(lo + (F.col("_d") + 1) * wide)
    return (df.withColumn("_place", F.struct(F.col("_d").alias("d1"), digit((F.col("_key") - start) / (end - start)).alias("d2"),
                                             F.col("_key").alias("key"), F.xxhash64(id_col).alias("tie"),
                                             F.col("_size").alias("size"), F.xxhash64(body).alias("body")))
            .drop("_key", "_d"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size) with ``target``: the total shared by weight, no target above
    ``max_repeats`` times its source. Sources fill up in the order of cap / weight; a source is
    full if its cap is below the level (what is left per weight) at its turn, and the level at
    the first one that is not full holds for it and all that follow. One row a source."""
    every = W.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    fill = every.orderBy("fill", "rank")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    return (sizes.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
            .withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
            .withColumn("fill", F.col("cap") / F.col("w"))
            .withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
            .withColumn("level", F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(
                fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
            .withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("w")))
            .select("source", "source_size", "target"))


def on_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on ``source``, null equal to null; ``right`` has one row a source."""
    r = right.withColumnRenamed("source", "_s")
    return left.join(r, F.col("source").eqNullSafe(F.col("_s")), how).drop("_s")


def decisions(sized: DataFrame, weights: tuple = WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """From (source, size, place): source, source_size, target, epochs, and ``last``, the last place
    of the source's order that is sampled beyond the complete epochs."""
    cells = written(sized.groupBy("source", F.col("place.d1").alias("d1")).agg(F.sum("size").alias("size")), "mix-cells")
    targets = (source_targets(cells.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
               .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                           .otherwise(F.lit(0)).cast("long"))
               .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    targets = written(targets, "mix-targets")

    def end_of(cells: DataFrame, budgets: DataFrame, digit: str, left: str) -> DataFrame:
        """The digit in which the budget of a source ends, and the budget left at its start."""
        end = F.sum("size").over(W.partitionBy("source").orderBy(digit))
        return (on_source(cells.withColumn("end", end), budgets.select("source", F.col(left).alias("_left")))
                .filter(F.col("end") > F.col("_left")).groupBy("source")
                .agg(F.min(F.struct(F.col(digit), (F.col("_left") - (F.col("end") - F.col("size"))).alias("left"))).alias("m"))
                .select("source", F.col(f"m.{digit}").alias(f"cut_{digit}"), F.col("m.left").alias(f"left_{digit}")))

    cut1 = written(end_of(cells, targets, "d1", "rest"), "mix-cut")
    inside = on_source(sized, cut1).filter(F.col("place.d1") == F.col("cut_d1"))
    cells2 = inside.groupBy("source", F.col("place.d2").alias("d2")).agg(F.sum("size").alias("size"))
    cut = written(on_source(cut1, end_of(cells2, cut1, "d2", "left_d1")), "mix-cut")

    cell = on_source(sized, cut).filter((F.col("place.d1") == F.col("cut_d1")) & (F.col("place.d2") == F.col("cut_d2")))
    # equal places share one prefix sum: the default frame of an ordered window is by value
    cell = cell.withColumn("end", F.sum("size").over(W.partitionBy("source").orderBy("place")))
    under = F.col("end") <= F.col("left_d2")
    ends = cell.groupBy("source").agg(
        F.max(F.when(under, F.struct("end", "place"))).alias("inner"),
        F.min(F.when(~under, F.struct("end", "place"))).alias("over"),
        F.first("left_d2").alias("left"), F.first("cut_d1").alias("d1"), F.first("cut_d2").alias("d2"))
    below = F.col("left") - F.coalesce(F.col("inner.end"), F.lit(0))
    none = F.struct(F.col("d1").alias("d1"), F.col("d2").alias("d2"), F.lit(0.0).alias("key"),
                    F.lit(0).cast("long").alias("tie"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("body"))
    last = F.when(F.col("over.end") - F.col("left") < below, F.col("over.place")).otherwise(F.coalesce(F.col("inner.place"), none))
    ends = ends.select("source", last.alias("last"))
    return written(on_source(targets, ends, "left").select("source", "source_size", "target", "epochs", "last"), "mix-plan")


def copies(place: Column) -> Column:
    """How often the mix takes a document, beside the columns of :func:`decisions`."""
    return F.col("epochs") + F.when((F.col("rest_open")) & (place <= F.col("last")), F.lit(1)).otherwise(F.lit(0))


def _open(plan: DataFrame) -> DataFrame:
    return plan.withColumn("rest_open", F.col("last").isNotNull() & (F.col("target") > F.col("epochs") * F.col("source_size")))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple = WEIGHTS, max_repeats: float = MAX_REPEATS, quality: Column | None = None) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken (= copies * size)."""
    keyed = with_keys(docs.select(id_col, text, source) if quality is None else docs, id_col, text, source, quality)
    sized = written(keyed.select(F.col(id_col).alias("id"), F.col("_source").alias("source"),
                                 F.col("_size").alias("size"), F.col("_place").alias("place")), "mix-sized")
    plan = _open(decisions(sized, weights, max_repeats))
    return (on_source(sized, plan, "left").withColumn("copies", copies(F.col("place")))
            .select("id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
                    weights: tuple = WEIGHTS, max_repeats: float = MAX_REPEATS, quality: Column | None = None) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken."""
    if quality is not None:
        docs = docs.withColumn(" quality", quality)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])     # the documents' own columns can have any names
    keyed = with_keys(docs.select(row.alias("_row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"),
                                  F.col(f"`{source}`").alias("source")), "id", "text", "source",
                      F.col("_row")[" quality"] if quality is not None else None).drop("id", "text", "source")
    sized = written(keyed.select(F.col("_source").alias("source"), F.col("_size").alias("size"),
                                 F.col("_place").alias("place")), "mix-sized")
    plan = _open(decisions(sized, weights, max_repeats)).withColumnRenamed("source", "_s")
    plan = plan.select("_s", *[F.col(c).alias(f"_{c}") for c in ("epochs", "last", "rest_open")])
    joined = keyed.join(plan, F.col("_source").eqNullSafe(F.col("_s")), "left")
    n = F.col("_epochs") + F.when(F.col("_rest_open") & (F.col("_place") <= F.col("_last")), 1).otherwise(0)
    return (joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), n.cast("int"))))
            .select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != " quality"]))
