"""Session helpers: a configured SparkSession and lineage cutting.

The library never creates its own checkpoint folder on a cluster: it reads
``spark.checkpoint.dir`` from the session and only falls back to a local
scratch folder when Spark runs in local mode (tests, bench).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "varscope") -> SparkSession:
    """Local/test session with AQE on and the UI off."""
    master = master or os.environ.get("VARSCOPE_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Column-level Python call-site capture costs several Py4J round trips per
        # expression; operators here build hundreds of expressions per plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("VARSCOPE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the checkpoint folder named by the session.

    When none is set and Spark runs in local mode, a fresh scratch folder is
    used (as in tests). On a cluster an unset folder stays unset and callers
    fall back to caching.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="varscope-ckpt-"))
        return sc.getCheckpointDir()
    return None


def materialize(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Cut the lineage of a (small, aggregated) intermediate result.

    ``max_rows`` (an upper bound of the row count) sizes the partition count,
    so iterative state built with ``union`` does not pile up partitions. The few rows
    are moved (``repartition``): ``coalesce`` would run all partitions of the steps before,
    each with its sort and hash buffers, in that one task.

    Reliable ``checkpoint`` into the shared checkpoint folder, so a lost
    executor does not force the whole iterative history to be recomputed.
    Without a checkpoint folder the result is cached and counted instead.
    """
    spark = df.sparkSession
    if max_rows is not None:
        df = df.repartition(max(1, -(-max_rows // 250_000)))
    cached = df.cache()  # the eager checkpoint then writes from the cache, not a recompute
    if ensure_checkpoint_dir(spark):
        out = cached.checkpoint(eager=True)
        cached.unpersist(blocking=False)
        return out
    cached.count()
    return cached
