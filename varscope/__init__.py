"""varscope - Spark-first tabular diagnostics.

DataFrame-in / DataFrame-out statistics for one flat (possibly joined)
table: typing and quality checks, profiles, outliers, pairwise association
with multiple-testing control, group effects, regressions, shape and
distribution diagnostics, what-if projections, findings and a score.
"""

__version__ = "0.1.0"
