"""gold_daily_metrics: one reconciled row per UTC event date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.timeutil import utc_date


def _is(t: str):
    return F.col("event_type") == t


def daily_metrics(silver: DataFrame, sessions: DataFrame) -> DataFrame:
    """Event counts by ``event_date`` left-joined with session counts by session
    start date. Both sides are pre-aggregated before the join, so the join
    input is one row per date (Spark's size statistics / AQE choose a
    broadcast when it is small); ``count(DISTINCT player_id)`` is the only
    distinct aggregate, which Spark plans without an Expand."""
    events = silver.groupBy("event_date").agg(
        F.count_distinct("player_id").alias("active_players"),
        F.count(F.lit(1)).alias("events"),
        F.count_if(_is("level_start")).alias("level_starts"),
        F.count_if(_is("level_complete")).alias("level_completions"),
        F.count_if(_is("purchase")).alias("purchases"),
        F.coalesce(F.sum(F.when(_is("purchase"), F.col("amount_cents"))), F.lit(0))
        .cast("bigint")
        .alias("revenue_cents"),
        F.count_if(F.col("is_late")).alias("late_events"),
    )
    by_start = sessions.groupBy(utc_date("session_started_at").alias("event_date")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.round(F.avg("duration_seconds"), 2).alias("average_session_seconds"),
    )
    return events.join(by_start, "event_date", "left").select(
        "event_date",
        "active_players",
        "events",
        F.coalesce("sessions", F.lit(0)).cast("bigint").alias("sessions"),
        "level_starts",
        "level_completions",
        "purchases",
        "revenue_cents",
        "late_events",
        F.coalesce("average_session_seconds", F.lit(0.0)).alias("average_session_seconds"),
        F.round(
            F.col("level_completions").cast("double") / F.nullif(F.col("level_starts"), F.lit(0)), 4
        ).alias("level_completion_rate"),
    )
