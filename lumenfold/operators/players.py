"""gold_player_summary: engagement, progression, spend and churn flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.schema import CHURN_DAYS


def player_summary(silver: DataFrame, sessions: DataFrame, churn_days: int = CHURN_DAYS) -> DataFrame:
    """Per-player aggregate. The dataset's latest date is a one-row aggregate
    joined to every player (a 1-row broadcast, bounded by construction);
    session counts are pre-aggregated per player before the left join."""
    etype = F.col("event_type")
    per_player = silver.groupBy("player_id").agg(
        F.min("event_date").alias("first_event_date"),
        F.max("event_date").alias("last_event_date"),
        F.count_distinct("event_date").alias("active_days"),
        F.coalesce(F.max(F.when(etype == "level_complete", F.col("level"))), F.lit(0)).alias("highest_level"),
        F.count_if(etype == "reset").alias("resets"),
        F.count_if(etype == "purchase").alias("purchases"),
        F.coalesce(F.sum(F.when(etype == "purchase", F.col("amount_cents"))), F.lit(0))
        .cast("bigint")
        .alias("revenue_cents"),
    )
    session_counts = sessions.groupBy("player_id").agg(F.count(F.lit(1)).alias("sessions"))
    latest = per_player.agg(F.max("last_event_date").alias("latest_date"))  # reuses the exchange of per_player
    return (
        per_player.join(session_counts, "player_id", "left")
        .crossJoin(F.broadcast(latest))
        .select(
            "player_id",
            "first_event_date",
            "last_event_date",
            "active_days",
            F.coalesce("sessions", F.lit(0)).cast("bigint").alias("sessions"),
            F.col("highest_level").cast("int").alias("highest_level"),
            "resets",
            "purchases",
            "revenue_cents",
            (F.datediff("latest_date", "last_event_date") >= churn_days).alias("churn_risk"),
        )
    )
