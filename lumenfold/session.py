"""Spark session settings the engine relies on.

All event-time arithmetic is defined in UTC (dates, minute/second boundaries),
so every entry point pins ``spark.sql.session.timeZone`` to UTC. ANSI mode
stays on: a plain divide by zero raises, which is why rates use ``nullif``.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

UTC = "UTC"


def build_session(
    master: str | None = None,
    app_name: str = "lumenfold",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the engine's required settings.

    ``shuffle_partitions`` defaults to the local core count; on a cluster pass
    a value sized so that one shuffle partition stays around 128-256 MB.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    cores = os.cpu_count() or 8
    conf = {
        "spark.sql.session.timeZone": UTC,
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Filter the big side of selective joins (e.g. bronze ids vs one batch).
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or cores),
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Keep generated methods small enough for the JIT (8000 bytecodes);
        # larger ones would run interpreted.
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    if master and master.startswith("local"):
        # Local mode: the driver JVM is the only executor.
        conf["spark.driver.memory"] = os.environ.get("LUMENFOLD_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Pin the session time zone to UTC (the metric definitions require it)."""
    if spark.conf.get("spark.sql.session.timeZone", None) != UTC:
        spark.conf.set("spark.sql.session.timeZone", UTC)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session; a private folder is only
    created when it is unset (local runs and tests).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a shared (cluster-visible) folder for staging tables"
        )
    # Local runs and tests only: a private folder on this machine.
    local = tempfile.mkdtemp(prefix="lumenfold-ckpt-")
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local
