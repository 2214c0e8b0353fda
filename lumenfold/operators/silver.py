"""Silver layer: normalised, dated and sequenced accepted events."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumenfold.functions.timeutil import second_diff, utc_date
from lumenfold.operators.ordering import DEFAULT_BUCKET_SECONDS, BucketPlan, add_sequence
from lumenfold.schema import SILVER_COLUMNS


def silver_columns(bronze: DataFrame) -> DataFrame:
    """Projection, UTC ``event_date`` and boundary-second arrival lag.

    Gold transforms only need these columns; ``event_sequence`` (C4) costs an
    ordered scan, so plans that do not persist silver skip it.
    """
    return bronze.select(
        "event_id",
        "player_id",
        "event_type",
        "event_time",
        "received_at",
        utc_date("event_time").alias("event_date"),
        second_diff("event_time", "received_at").alias("arrival_lag_seconds"),
        "game_version",
        "platform",
        "level",
        "amount_cents",
        "currency",
        "reason",
        "is_late",
        "batch_id",
    )


def silver(bronze: DataFrame, bucket_seconds: int | BucketPlan = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Full silver table: C1-C3 plus the per-player ``event_sequence`` ordered by
    (event_time, event_id)."""
    return add_sequence(silver_columns(bronze), bucket_seconds=bucket_seconds).select(*SILVER_COLUMNS)
