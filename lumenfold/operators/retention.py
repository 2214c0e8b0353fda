"""gold_retention: exact-day D0/D1/D7 retention by first-seen cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.schema import RETENTION_DAYS


def active_days(silver: DataFrame) -> DataFrame:
    """Distinct (player_id, event_date); aggregated map-side before the shuffle."""
    return silver.select("player_id", "event_date").distinct()


def retention(silver: DataFrame, days: Sequence[int] = RETENTION_DAYS) -> DataFrame:
    """A player is retained on day n when active exactly on cohort_date + n.

    Each distinct (player, date) row learns its player's cohort date from a
    per-player ``min`` window -- the rows per player are its active *days*,
    bounded by the calendar, not by its event volume -- and becomes a day
    offset. One aggregate per cohort counts offsets 0 (the cohort size: every
    player is active on its first day) and each requested n, and ``inline``
    emits one row per day: no grid join against the active rows.
    """
    wanted = sorted({0, *[int(d) for d in days]})
    active = active_days(silver)
    offsets = active.select(
        F.min("event_date").over(Window.partitionBy("player_id")).alias("cohort_date"),
        "event_date",
    ).select("cohort_date", F.datediff("event_date", "cohort_date").alias("day_number"))
    per_cohort = offsets.filter(F.col("day_number").isin(*wanted)).groupBy("cohort_date").agg(
        *[F.count_if(F.col("day_number") == d).alias(f"_d{d}") for d in wanted]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(int(d)).alias("day_number"),
                F.col("_d0").alias("cohort_size"),
                F.col(f"_d{int(d)}").alias("retained_players"),
            )
            for d in days
        ]
    )
    return per_cohort.select("cohort_date", F.inline(rows)).select(
        "cohort_date",
        F.col("day_number").cast("int").alias("day_number"),
        "cohort_size",
        "retained_players",
        F.round(
            F.col("retained_players").cast("double") / F.nullif(F.col("cohort_size"), F.lit(0)), 4
        ).alias("retention_rate"),
    )
