"""gold_funnel: daily distinct players per progression stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.schema import FUNNEL_STAGES


def funnel(silver: DataFrame, stages: Sequence[tuple[int, str, str]] = FUNNEL_STAGES) -> DataFrame:
    """Dense (date x stage) rows so empty stages report 0; conversion is players
    over the previous stage's players (can exceed 1; stage 1 is 1.0).

    One scan: distinct players per (date, event_type) over *all* types (so
    every active date appears), folded to one row per date holding each
    stage's count, then emitted as one row per stage with ``inline``. The
    previous stage's count sits in the same row -- no grid join, no window.
    """
    per_type = silver.groupBy("event_date", "event_type").agg(F.count_distinct("player_id").alias("players"))
    per_date = per_type.groupBy("event_date").agg(
        *[
            F.coalesce(F.max(F.when(F.col("event_type") == etype, F.col("players"))), F.lit(0))
            .cast("bigint")
            .alias(f"_s{order}")
            for order, _, etype in stages
        ]
    )
    ordered = sorted(stages)
    rows = F.array(
        *[
            F.struct(
                F.lit(int(order)).alias("stage_order"),
                F.lit(stage).alias("stage"),
                F.col(f"_s{order}").alias("players"),
                (F.col(f"_s{ordered[k - 1][0]}") if k > 0 else F.lit(None).cast("bigint")).alias("previous"),
            )
            for k, (order, stage, _) in enumerate(ordered)
        ]
    )
    exploded = per_date.select("event_date", F.inline(rows))
    return exploded.select(
        "event_date",
        "stage_order",
        "stage",
        "players",
        F.when(F.col("stage_order") == ordered[0][0], F.lit(1.0))
        .otherwise(F.round(F.col("players").cast("double") / F.nullif(F.col("previous"), F.lit(0)), 4))
        .alias("conversion_from_previous"),
    )
