"""gold_anomaly_candidates: explainable late, order and burst candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import concat_skip_nulls
from lumenfold.schema import BURST_THRESHOLD

ANOMALY_COLUMNS = ["anomaly_id", "player_id", "event_id", "event_time", "anomaly_type", "evidence"]
_UNIT_SECONDS = {"minute": 60, "hour": 3600}


def late_arrivals(silver: DataFrame) -> DataFrame:
    return silver.filter(F.col("is_late")).select(
        concat_skip_nulls(F.lit("late-"), F.col("event_id")).alias("anomaly_id"),
        "player_id",
        "event_id",
        "event_time",
        F.lit("late_arrival").alias("anomaly_type"),
        concat_skip_nulls(F.lit("arrival lag "), F.col("arrival_lag_seconds"), F.lit(" seconds")).alias(
            "evidence"
        ),
    )


def completion_without_start(silver: DataFrame) -> DataFrame:
    """level_complete with no level_start of the same (player, level) at or
    before it. NOT EXISTS with a theta predicate is rewritten as a left join to
    the *earliest* start per (player, level): one row per key on the right,
    so the join never multiplies rows, and a skewed key on the left side is
    split by AQE's skew-join handling. A NULL level never matches."""
    completed = silver.filter(F.col("event_type") == "level_complete").select(
        "player_id", "event_id", "event_time", "level"
    )
    first_start = (
        silver.filter((F.col("event_type") == "level_start") & F.col("level").isNotNull())
        .groupBy(F.col("player_id").alias("s_player"), F.col("level").alias("s_level"))
        .agg(F.min("event_time").alias("first_start"))
    )
    joined = completed.join(
        first_start,
        (completed.player_id == first_start.s_player) & (completed.level == first_start.s_level),
        "left",
    )
    return joined.filter(
        F.col("first_start").isNull() | (F.col("first_start") > F.col("event_time"))
    ).select(
        concat_skip_nulls(F.lit("order-"), F.col("event_id")).alias("anomaly_id"),
        "player_id",
        "event_id",
        "event_time",
        F.lit("completion_without_start").alias("anomaly_type"),
        concat_skip_nulls(F.lit("no earlier level_start for level "), F.col("level")).alias("evidence"),
    )


def bursts(silver: DataFrame, unit: str = "minute", over: int = BURST_THRESHOLD) -> DataFrame:
    """More than ``over`` events per player in one event-time ``unit``."""
    seconds = _UNIT_SECONDS[unit]
    window_start = F.timestamp_seconds(F.floor(F.unix_seconds("event_time") / seconds) * seconds)
    grouped = silver.groupBy("player_id", window_start.alias("window_start")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("event_id").alias("event_id"),
        F.min("event_time").alias("event_time"),
    )
    return grouped.filter(F.col("n") > over).select(
        concat_skip_nulls(
            F.lit("burst-"), F.col("player_id"), F.lit("-"), F.unix_millis("window_start")
        ).alias("anomaly_id"),
        "player_id",
        "event_id",
        "event_time",
        F.lit("event_burst").alias("anomaly_type"),
        concat_skip_nulls(F.col("n"), F.lit(f" events in one {unit}")).alias("evidence"),
    )


def anomalies(silver: DataFrame, burst_unit: str = "minute", burst_over: int = BURST_THRESHOLD) -> DataFrame:
    return (
        late_arrivals(silver)
        .unionByName(completion_without_start(silver))
        .unionByName(bursts(silver, burst_unit, burst_over))
    )
