"""gold_sessions: inactivity-gap sessionisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.timeutil import second_diff
from lumenfold.operators.ordering import DEFAULT_BUCKET_SECONDS, BucketPlan, session_fragments
from lumenfold.schema import SESSION_GAP_MINUTES


def sessions(
    silver: DataFrame,
    gap_minutes: int = SESSION_GAP_MINUTES,
    bucket_seconds: int | BucketPlan = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """One row per (player, session). A session starts at a player's first event
    or when >= ``gap_minutes`` minute boundaries separate consecutive events.

    Rows are shuffled once (by player and UTC day); per-session measures are
    folded into fragments in that stage and fragments are merged per
    (player, session_number) on the player partitioning the fragment window
    already produced -- no second exchange of rows.
    """
    etype = F.col("event_type")
    frags = session_fragments(
        silver.select("player_id", "event_id", "event_time", "event_type", "is_late"),
        gap_minutes,
        {
            "_n": F.count(F.lit(1)),
            "_completed": F.count_if(etype == "level_complete"),
            "_purchases": F.count_if(etype == "purchase"),
            "_late": F.bool_or("is_late"),
        },
        bucket_seconds=bucket_seconds,
    )
    agg = frags.groupBy("player_id", "session_number").agg(
        F.min("_first").alias("session_started_at"),
        F.max("_last").alias("session_ended_at"),
        F.sum("_n").alias("event_count"),
        F.sum("_completed").alias("levels_completed"),
        F.sum("_purchases").alias("purchases"),
        F.bool_or("_late").alias("contains_late_event"),
    )
    return agg.select(
        F.concat(
            F.col("player_id"), F.lit("-s"), F.lpad(F.col("session_number").cast("string"), 4, "0")
        ).alias("session_id"),
        "player_id",
        "session_number",
        "session_started_at",
        "session_ended_at",
        second_diff("session_started_at", "session_ended_at").alias("duration_seconds"),
        F.col("event_count").cast("bigint").alias("event_count"),
        F.col("levels_completed").cast("bigint").alias("levels_completed"),
        F.col("purchases").cast("bigint").alias("purchases"),
        "contains_late_event",
    )
