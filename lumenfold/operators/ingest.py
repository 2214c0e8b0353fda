"""Batch routing: duplicates, bronze rows, quarantine rows, receipt counts
(B17-B25, A8).

Validation is a projection. Duplicates are found on two narrow columns
(``event_id``, ``line_number``); only the few lines that are duplicates are
then joined to the whole rows.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.hashing import quarantine_id
from lumenfold.operators.validate import validate
from lumenfold.schema import BRONZE_COLUMNS
from lumenfold.sources.tables import spread

HUGE_METHOD_CONF = "spark.sql.codegen.hugeMethodLimit"
#: Bytecodes above which the JVM never compiles a method to machine code.
JIT_METHOD_LIMIT = "8000"
#: From a table of event ids to those of them that are committed.
Lookup = Callable[[DataFrame], DataFrame]


def materialize(df: DataFrame, location: str | None = None) -> DataFrame:
    """Cut the lineage with a Parquet table written once into the cluster's
    shared ``spark.checkpoint.dir`` (or ``location``) and read back.

    The validated batch is read three to four times (bronze, quarantine,
    counts, duplicate check); one columnar write replaces re-parsing it, the
    table survives executor loss, and the optimiser sees a plain scan (so
    routing predicates are pushed into Parquet instead of into the per-rule
    expressions). ``DataFrame.checkpoint`` would compute the plan twice."""
    import uuid

    from lumenfold.session import checkpoint_dir

    path = location or f"{checkpoint_dir(df.sparkSession).rstrip('/')}/lumenfold-stage-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def compiled_methods(spark: SparkSession):
    """Within it, stages whose generated method the JVM would only interpret (as that of
    the contract rules) run as one smaller generated class per operator instead."""
    before = spark.conf.get(HUGE_METHOD_CONF, None)
    if before == JIT_METHOD_LIMIT:
        yield
        return
    spark.conf.set(HUGE_METHOD_CONF, JIT_METHOD_LIMIT)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(HUGE_METHOD_CONF)
        else:
            spark.conf.set(HUGE_METHOD_CONF, before)


def stage_validated(
    lines: DataFrame, location: str | None = None, strict_duplicates: bool = False, partitions: int | None = None
) -> DataFrame:
    """``validate`` of all lines, written once. Its cost per line is some hundred times that
    of a shuffle, so without ``partitions`` the lines are dealt out by their bytes first."""
    dealt = spread(lines) if partitions is None else lines
    with compiled_methods(lines.sparkSession):
        return materialize(validate(dealt, strict_duplicates, partitions), location)


def route(
    lines: DataFrame,
    existing_ids: DataFrame | Lookup | None = None,
    strict_duplicates: bool = False,
    checked: DataFrame | None = None,
    partitions: int | None = None,
    staging: str | None = None,
) -> DataFrame:
    """Validated lines with the final ``reason_code`` (NULL = accepted).

    Only contract-valid lines compete for an ``event_id``: the lowest line
    number wins, later copies and ids already present in bronze become
    ``duplicate_event``. A hot id (one copy group holding a large share of
    the batch) is merged map-side by the aggregate and split by AQE's
    skew-join handling in the joins back. With ``staging`` the duplicates are
    written there first: what is returned then reads neither ``existing_ids``
    again nor shuffles whole rows while that table is small.
    """
    if checked is None:
        checked = stage_validated(lines, None, strict_duplicates, partitions)
    valid = checked.filter(F.col("reason_code").isNull())
    rejected = checked.filter(F.col("reason_code").isNotNull())
    twice = duplicate_lines(valid.select("event_id", "line_number"), existing_ids)
    if staging is not None:
        twice = materialize(twice, staging)
    decided = valid.join(twice, ["event_id", "line_number"], "left").withColumns({
        "reason_code": F.when(F.col("_twice"), F.lit("duplicate_event")),
        "details": F.when(F.col("_twice"), F.col("event_id")).otherwise(F.col("details")),
    })
    return decided.drop("_twice").unionByName(rejected)


def duplicate_lines(keys: DataFrame, existing_ids: DataFrame | Lookup | None = None) -> DataFrame:
    """(event_id, line_number, ``_twice``) of the lines whose id an earlier line or ``existing_ids`` holds.

    ``existing_ids`` is a table of ids, or a function from a table of ids to those of them that exist.
    """
    per_id = keys.groupBy("event_id").agg(F.min("line_number").alias("_first"), F.max("line_number").alias("_last"))
    if existing_ids is None:
        per_id = per_id.withColumn("_known", F.lit(False))
    else:
        ids = per_id.select("event_id")
        if isinstance(existing_ids, DataFrame):
            held = ids.join(existing_ids.select("event_id"), "event_id", "left_semi")
        else:
            held = existing_ids(ids)
        per_id = per_id.join(held.withColumn("_known", F.lit(True)), "event_id", "left")
    known = F.coalesce("_known", F.lit(False))
    several = per_id.where(known | (F.col("_last") > F.col("_first")))
    rows = keys.join(several, "event_id").where(known | (F.col("line_number") > F.col("_first")))
    return rows.select("event_id", "line_number", F.lit(True).alias("_twice")).distinct()


def _cut(name: str, chars: int | None):
    """A text column, whole or (B20) cut to ``chars`` characters."""
    return F.col(name) if chars is None else F.substring(name, 1, chars)


def bronze_rows(routed: DataFrame, payload_chars: int | None = None) -> DataFrame:
    """Accepted lines flattened to the bronze schema."""
    return routed.filter(F.col("reason_code").isNull()).select(
        *[c for c in BRONZE_COLUMNS if c not in ("raw_payload", "is_late", "batch_id")],
        "is_late",
        "batch_id",
        _cut("raw", payload_chars).alias("raw_payload"),
    ).select(*BRONZE_COLUMNS)


def quarantine_rows(
    routed: DataFrame, quarantined_at=None, payload_chars: int | None = None, detail_chars: int | None = None
) -> DataFrame:
    """Rejected lines with a deterministic id."""
    at = F.lit(quarantined_at).cast("timestamp") if quarantined_at is not None else F.current_timestamp()
    return routed.filter(F.col("reason_code").isNotNull()).select(
        quarantine_id(F.col("batch_id"), F.col("line_number"), F.col("reason_code")).alias("quarantine_id"),
        "batch_id",
        "line_number",
        "reason_code",
        F.coalesce(_cut("details", detail_chars), F.lit("")).alias("details"),
        _cut("raw", payload_chars).alias("raw_payload"),
        at.alias("quarantined_at"),
    )


def receipt_counts(routed: DataFrame) -> DataFrame:
    """received = accepted + quarantined, in one global aggregate."""
    return routed.agg(
        F.count(F.lit(1)).alias("received_count"),
        F.count_if(F.col("reason_code").isNull()).alias("accepted_count"),
        F.count_if(F.col("reason_code").isNotNull()).alias("quarantine_count"),
    )


def reason_summary(quarantine: DataFrame) -> DataFrame:
    """B25 runbook view: rows per batch and reason code."""
    return quarantine.groupBy("batch_id", "reason_code").agg(F.count(F.lit(1)).alias("rows"))
