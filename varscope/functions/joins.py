"""Join helper shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
               extra: Sequence[str] = ()) -> DataFrame:
    """Join on ``keys`` with NULL-safe equality (segments may be NULL) plus
    plain equality on ``extra``; the right-hand key copies are dropped."""
    keys, extra = list(keys), list(extra)
    if not keys and not extra:
        # no segment: the right side is a global (one-row) aggregate -> broadcast equi-join on a constant
        one = F.lit(1).alias("__one")
        return left.select("*", one).join(F.broadcast(right.select("*", one)), "__one", how).drop("__one")
    ren = {c: f"__r_{i}" for i, c in enumerate(keys + extra)}
    r = right.select(*[F.col(c).alias(ren[c]) if c in ren else F.col(c) for c in right.columns])
    conds = ([left[c].eqNullSafe(r[ren[c]]) for c in keys]
             + [left[c] == r[ren[c]] for c in extra])
    cond = reduce(lambda a, b: a & b, conds) if conds else F.lit(True)
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "semi", "leftsemi", "left_anti", "anti", "leftanti") else out.drop(*ren.values())


#: Bytes of a per-segment table up to which it is broadcast to the raw rows.
LOOKUP_BYTES = 32 << 20
#: Copies of a larger table's rows, over which the rows of a hot segment are spread.
SALTS = 16


def lookup_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Inner join of raw ``rows`` with an aggregated ``table`` (one row a key) that leaves the rows where they are.

    The table is written down and measured; up to :data:`LOOKUP_BYTES` it is broadcast and no row moves. A larger one
    is joined on the keys and a salt, so that a key with a third of all rows is met by several tasks.
    """
    from ..session import materialize
    keys, extra = list(keys), list(extra)
    if not keys and not extra:
        return keyed_join(rows, table, keys)
    table = materialize(table)
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct(*table.columns))))).first()[0] or 0
    if size <= LOOKUP_BYTES:
        return keyed_join(rows, F.broadcast(table), keys, extra=extra)
    salted = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return keyed_join(rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))), salted, keys, extra=[*extra, "_salt"]).drop("_salt")
