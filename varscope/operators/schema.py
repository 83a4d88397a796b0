"""P1-P4, P9, P11 - column roles, identifiers and temporal columns.

One wide aggregate over all columns gives, per column, the counts the role
rules need; the rules are a CASE over that single aggregated row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_list, distinct_counts, is_integral, is_numeric, is_temporal, is_text, num
from ..functions.joins import keyed_join

# Fixed values that must equal the reference's behaviour.
# Two-valued text columns whose trimmed, lower-cased values are one of these pairs are boolean.
BOOLEAN_PAIRS = [("oui", "non"), ("yes", "no"), ("true", "false"), ("vrai", "faux"), ("o", "n")]
# Column-name keywords that mark a temporal column.
TEMPORAL_KEYWORDS = ["date", "semaine", "week", "mois", "month", "saison", "season", "trimestre",
                     "quarter", "annee", "year", "jour", "day", "periode", "timestamp", "heure", "hour"]

# Date layouts accepted when recognising text dates (pandas "mixed" parsing covers these and more).
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm",
                "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy-MM",
                "dd/MM/yyyy HH:mm", "dd/MM/yyyy HH:mm:ss", "MMM yyyy", "d MMM yyyy", "MMMM yyyy", "d MMMM yyyy",
                "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy"]
# ISO date-times may end in a fraction of a second and a zone; both are cut before parsing.
ISO_TAIL = r"(?<=:[0-9]{2})(\.[0-9]{1,9})?(Z|z| ?[+-][0-9]{2}:?[0-9]{2})?$"

ROLES = ("numeric_continuous", "numeric_discrete", "categorical", "boolean", "datetime",
         "identifier", "text_free", "unknown")


# Only strings shaped like one of DATE_FORMATS reach the (costly) parsers.
DATE_SHAPE = (r"^([0-9]{1,4}[-/.][0-9]{1,2}([-/.][0-9]{1,4})?([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?"
              r"|[0-9]{8}|([0-9]{1,2} )?[A-Za-z]{3,9}\.? [0-9]{4}|[A-Za-z]{3,9} [0-9]{1,2},? [0-9]{4})$")


def parses_as_date(c: Column) -> Column:
    s = F.regexp_replace(F.trim(c), ISO_TAIL, "")
    parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in DATE_FORMATS]).isNotNull()
    return F.when(s.rlike(DATE_SHAPE), parsed).otherwise(F.lit(False))


def _column_aggs(df: DataFrame, name: str, i: int, approx_distinct: bool) -> list[Column]:
    c = F.col(name)
    aggs = [F.count(c).alias(f"n_{i}")]
    if approx_distinct:
        aggs.append(F.approx_count_distinct(num(name) if is_numeric(df, name) else c).alias(f"d_{i}"))
    if is_numeric(df, name):
        x = num(name)
        aggs += [F.count(x).alias(f"nv_{i}"),
                 F.min(x).alias(f"mn_{i}"), F.max(x).alias(f"mx_{i}"),
                 F.bool_and(F.when(x.isNotNull(), x % 1 == 0)).alias(f"int_{i}")]
    elif is_text(df, name):
        low = F.lower(F.trim(c))
        aggs += [F.min(low).alias(f"lmn_{i}"), F.max(low).alias(f"lmx_{i}"),
                 F.bool_and(F.when(c.isNotNull(), parses_as_date(c))).alias(f"date_{i}")]
    return aggs


def _role(df: DataFrame, name: str, i: int) -> tuple[Column, Column]:
    n, d = F.col(f"n_{i}"), F.col(f"d_{i}")
    ratio = F.try_divide(d, n)
    tail = (F.when((ratio > 0.9) & (n > 3), F.lit("identifier"))
            .when(ratio <= 0.5, F.lit("categorical")).otherwise(F.lit("text_free")))
    if is_numeric(df, name):
        nv = F.col(f"nv_{i}")
        mn, mx, ints = F.col(f"mn_{i}"), F.col(f"mx_{i}"), F.col(f"int_{i}")
        role = (F.when(nv == 0, F.lit("unknown"))
                .when((d == 2) & (mn == 0) & (mx == 1), F.lit("boolean"))
                .when(ints, F.lit("numeric_discrete")).otherwise(F.lit("numeric_continuous")))
        sequential = (nv >= 4) & ints & (nv == d) & ((mx - mn) == (nv - 1))
        return role, sequential
    if isinstance(df.schema[name].dataType, T.BooleanType):   # a 0/1 column: one value alone is discrete
        return F.when(n == 0, F.lit("unknown")).when(d == 2, F.lit("boolean")).otherwise(F.lit("numeric_discrete")), F.lit(False)
    if is_temporal(df, name):
        return F.when(n == 0, F.lit("unknown")).otherwise(F.lit("datetime")), F.lit(False)
    if is_text(df, name):
        lmn, lmx = F.col(f"lmn_{i}"), F.col(f"lmx_{i}")
        is_bool = F.lit(False)
        for a, b in BOOLEAN_PAIRS:
            lo, hi = min(a, b), max(a, b)
            is_bool = is_bool | ((lmn == lo) & (lmx == hi))
        role = (F.when(n == 0, F.lit("unknown"))
                .when((d == 2) & is_bool, F.lit("boolean"))
                .when(F.col(f"date_{i}"), F.lit("datetime"))
                .otherwise(tail))
        return role, F.lit(False)
    return F.when(n == 0, F.lit("unknown")).otherwise(tail), F.lit(False)


def column_types(df: DataFrame, cols: Sequence[str] | None = None, approx_distinct: bool = False,
                 by: Sequence[str] | None = None) -> DataFrame:
    """``by..., column, position, dtype, n, n_distinct, role, is_identifier``."""
    by = as_list(by)
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in by]
    aggs = [a for i, c in enumerate(cols) for a in _column_aggs(df, c, i, approx_distinct)]
    wide = df.groupBy(*by).agg(*aggs)
    if not approx_distinct:
        # exact distinct counts come from their own long-form job, turned into one row a segment
        dc = distinct_counts(df, cols, by).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("column", "n_distinct"))).alias("_of"))
        wide = keyed_join(wide, dc.select(*by, *[F.coalesce(F.element_at("_of", F.lit(c)), F.lit(0)).cast("long").alias(f"d_{i}")
                                                 for i, c in enumerate(cols)]), by, "left")
        wide = wide.fillna(0, [f"d_{i}" for i in range(len(cols))])
    entries = []
    for i, c in enumerate(cols):
        role, seq = _role(df, c, i)
        entries.append(F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                                F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                                F.col(f"n_{i}").alias("n"), F.col(f"d_{i}").alias("n_distinct"),
                                role.alias("role"), ((role == "identifier") | seq).alias("is_identifier")))
    return wide.select(*by, F.explode(F.array(*entries)).alias("_t")).select(*by, "_t.*")


def identifier_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """P4 names (one small aggregated row per column reaches the driver)."""
    return [r["column"] for r in column_types(df, cols).where("is_identifier").collect()]


def legitimate_numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are not identifiers, in schema order."""
    cols = [c for c in df.columns if c not in set(exclude) and is_numeric(df, c)]
    if not cols:
        return []
    ids = set(identifier_columns(df, cols))
    return [c for c in cols if c not in ids]


def name_tokens(name: str) -> list[str]:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return [t.lower() for t in re.split(r"[_\-\s]+", spaced) if t]


def temporal_columns(df: DataFrame, distinct_counts: dict[str, int] | None = None) -> list[str]:
    """Real date/timestamp columns, plus columns whose name carries a
    temporal keyword (float columns excluded, integer columns with more than
    52 distinct values excluded)."""
    out = []
    for f in df.schema.fields:
        if is_temporal(df, f.name):
            out.append(f.name)
            continue
        if not set(name_tokens(f.name)) & set(TEMPORAL_KEYWORDS):
            continue
        if is_numeric(df, f.name) and not is_integral(df, f.name):
            continue
        if is_integral(df, f.name):
            d = (distinct_counts or {}).get(f.name)
            if d is None:
                d = df.agg(F.count_distinct(f.name)).first()[0]
            if d > 52:
                continue
        out.append(f.name)
    return out


def temporal_flags(df: DataFrame, types: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """P9 by segment: ``by..., column`` of the temporal columns of each segment, from :func:`column_types`."""
    sure = temporal_columns(df, {f.name: 0 for f in df.schema.fields})
    counted = [c for c in sure if is_integral(df, c)]        # temporal up to 52 distinct values
    return types.where(F.col("column").isin(*sure) & (~F.col("column").isin(*counted) | (F.col("n_distinct") <= 52))) \
        .select(*as_list(by), "column")


def sequential_in_order(df: DataFrame, col: str, order_by: str, by: Sequence[str] | None = None,
                        n_partitions: int | None = None) -> DataFrame:
    """W1/P4 with a row order: are the consecutive differences of ``col`` (rows
    sorted by ``order_by``) all the same step of +1 or -1? (n >= 4, integers.)

    A global ``lag`` would put every row in one task. Instead the rows are
    range-partitioned on (segment, order key); each Spark partition checks its
    own consecutive differences with a window bounded by that partition, and a
    small per-(partition, segment) table checks the boundaries between
    neighbouring partitions. Ties in the order key make the order ambiguous:
    they count as not sequential.
    """
    by = list(by or [])
    spark = df.sparkSession
    parts = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x, k = num(col), F.col(order_by)
    rows = (df.select(*by, k.alias("_k"), x.alias("_x")).where(F.col("_k").isNotNull() & F.col("_x").isNotNull())
            .repartitionByRange(parts, *[F.col(b) for b in by], "_k")
            .withColumn("_pid", F.spark_partition_id()))
    from pyspark.sql import Window
    w = Window.partitionBy("_pid", *by).orderBy("_k")
    d = rows.withColumn("_d", F.col("_x") - F.lag("_x").over(w)).withColumn("_dk", F.col("_k") == F.lag("_k").over(w))
    per = d.groupBy("_pid", *by).agg(
        F.count(F.lit(1)).alias("n"), F.min("_d").alias("dmin"), F.max("_d").alias("dmax"),
        F.bool_or(F.coalesce("_dk", F.lit(False))).alias("ties"),
        F.bool_and(F.abs(F.col("_x") - F.round("_x")) == 0).alias("ints"),
        F.min_by("_x", "_k").alias("x_first"), F.max_by("_x", "_k").alias("x_last"),
        F.min("_k").alias("k_first"), F.max("_k").alias("k_last"))
    wb = Window.partitionBy(*by).orderBy("_pid")
    per = (per.withColumn("_bd", F.col("x_first") - F.lag("x_last").over(wb))
              .withColumn("_bk", F.col("k_first") == F.lag("k_last").over(wb)))
    steps = F.array_compact(F.array("dmin", "dmax", "_bd"))
    agg = per.groupBy(*by).agg(
        F.sum("n").alias("n"), F.bool_and("ints").alias("ints"),
        F.bool_or(F.col("ties") | F.coalesce("_bk", F.lit(False))).alias("ties"),
        F.min(F.array_min(steps)).alias("smin"), F.max(F.array_max(steps)).alias("smax"))
    seq = ((F.col("n") >= 4) & F.col("ints") & ~F.col("ties") & (F.col("smin") == F.col("smax"))
           & (F.abs(F.col("smin")) == 1))
    return agg.select(*by, F.lit(col).alias("column"), F.lit(order_by).alias("order_by"), "n",
                      F.coalesce(seq, F.lit(False)).alias("is_sequential"))
