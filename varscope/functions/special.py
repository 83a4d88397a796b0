"""M1 - p-values without scipy.

The regularised incomplete beta function I_x(a, b) comes from Apache Commons
Math, which ships on Spark's classpath, called through ``try_reflect``. It is
only evaluated on aggregated rows (pairs, groups, segments), never per input
row, so the missing code generation of ``reflect`` does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BETA_CLASS = "org.apache.commons.math3.special.Beta"


def _d(c: Column | float) -> Column:
    return (c if isinstance(c, Column) else F.lit(float(c))).cast("double")


def reg_incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """I_x(a, b) with the edges x<=0 -> 0 and x>=1 -> 1; NULL on bad input."""
    x, a, b = _d(x), _d(a), _d(b)
    val = F.try_reflect(F.lit(_BETA_CLASS), F.lit("regularizedBeta"), x, a, b).cast("double")
    return (F.when(x.isNull() | a.isNull() | b.isNull() | (a <= 0) | (b <= 0), F.lit(None).cast("double"))
            .when(x <= 0, F.lit(0.0))
            .when(x >= 1, F.lit(1.0))
            .otherwise(val))


def pearson_pvalue(r: Column, n: Column) -> Column:
    """Two-sided p of Pearson's r with n pairs: I_{1-r^2}((n-2)/2, 1/2)."""
    r, n = _d(r), _d(n)
    df = n - 2
    p = reg_incomplete_beta(1 - r * r, df / 2, F.lit(0.5))
    return (F.when((n <= 2) | r.isNull(), F.lit(None).cast("double"))
            .when(F.abs(r) >= 1, F.lit(0.0))
            .otherwise(p))


def t_pvalue(t: Column, dof: Column) -> Column:
    """Two-sided p of a Student t statistic: I_{df/(df+t^2)}(df/2, 1/2)."""
    t, dof = _d(t), _d(dof)
    return F.when(dof <= 0, F.lit(None).cast("double")).otherwise(
        reg_incomplete_beta(dof / (dof + t * t), dof / 2, F.lit(0.5)))


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of the F distribution: I_{d2/(d2+d1 F)}(d2/2, d1/2)."""
    f, d1, d2 = _d(f), _d(d1), _d(d2)
    return (F.when(f.isNull(), F.lit(None).cast("double"))
            .when(f == F.lit(float("inf")), F.lit(0.0))
            .when(f <= 0, F.lit(1.0))
            .otherwise(reg_incomplete_beta(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)))
