"""As-known-at cohort review.

Membership comes from each player's *first visible* event; activity on any
platform counts afterwards. Visibility uses UTC dates of both receipt and
event time, so late information that had not arrived by the cutoff cannot
leak into the review. Day-n retention uses mature denominators only.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.timeutil import utc_date
from lumenfold.schema import GAME_VERSION_PATTERN, MAX_VERSION_LENGTH, PLATFORMS, RETENTION_DAYS

DEFINITION = (
    "Cohort membership and acquisition platform/version come from each player's first "
    "visible event; later activity on any platform counts. Events are visible when both "
    "their received date and event date (UTC) are on or before the cutoff. Day-n retention "
    "is exact-day activity over players whose day n is on or before the cutoff; a null rate "
    "means censored, not zero. The watermark reflects observed receipt, not completeness."
)


@dataclass(frozen=True)
class CohortReview:
    header: DataFrame
    totals: DataFrame
    retention: DataFrame


def validate_filters(start, end, platform, version) -> None:
    """K1: refuse filters that no event can meet."""
    known_version = re.compile(GAME_VERSION_PATTERN.strip("^$"))
    fits = isinstance(version, str) and len(version) <= MAX_VERSION_LENGTH and known_version.fullmatch(version)
    refusals = {
        f"no day lies between {start} and {end}": None not in (start, end) and end < start,
        f"events have no platform {platform!r}": platform not in (None, *PLATFORMS),
        f"{version!r} is not written as a game version": version is not None and not fits,
    }
    for text, refused in refusals.items():
        if refused:
            raise ValueError(text)


def watermark(silver: DataFrame) -> DataFrame:
    """K2: 1-row ``available_through`` = max UTC received date."""
    return silver.agg(F.max(utc_date("received_at")).alias("available_through"))


def visible_events(silver: DataFrame, cutoff: Column) -> DataFrame:
    """K3/K4: events known by ``cutoff`` with a session-zone-independent UTC date.
    A NULL cutoff (no data) makes every predicate NULL -> no rows (K13)."""
    return (
        silver.drop("event_date")
        .withColumn("event_date", utc_date("event_time"))
        .filter((utc_date("received_at") <= cutoff) & (F.col("event_date") <= cutoff))
    )


def members(visible: DataFrame, start=None, end=None, platform=None, version=None) -> DataFrame:
    """K5/K6: first visible event per player by (event_time, event_id), via a
    partial-aggregating ``min`` over a struct (no per-player window, so a hot
    player is merged map-side). Filters apply to that first event only."""
    first = visible.groupBy("player_id").agg(
        F.min(F.struct("event_time", "event_id", "event_date", "platform", "game_version")).alias("f")
    )
    m = first.select(
        "player_id",
        F.col("f.event_date").alias("cohort_date"),
        F.col("f.platform").alias("platform"),
        F.col("f.game_version").alias("game_version"),
    )
    if start is not None:
        m = m.filter(F.col("cohort_date") >= F.lit(start))
    if end is not None:
        m = m.filter(F.col("cohort_date") <= F.lit(end))
    if platform is not None:
        m = m.filter(F.col("platform") == F.lit(platform))
    if version is not None:
        m = m.filter(F.col("game_version") == F.lit(version))
    return m.select("player_id", "cohort_date")


def retention_frame(visible: DataFrame, member_df: DataFrame, cutoff: Column, days: Sequence[int]) -> DataFrame:
    """K7-K10. Members' distinct active days (visible events on any platform)
    become day offsets from their cohort date; one aggregate per cohort counts
    offset 0 (the cohort size: a member's first visible event is on its
    cohort date) and each requested n. Maturity (cohort_date + n <= cutoff)
    is the same for every member of a cohort, so mature and retained counts
    follow per (cohort, n) without a members x days grid."""
    wanted = sorted({0, *[int(d) for d in days]})
    active = visible.select("player_id", "event_date").distinct()
    offsets = active.join(member_df, "player_id").select(
        "cohort_date", F.datediff("event_date", "cohort_date").alias("day_number")
    )
    per_cohort = offsets.filter(F.col("day_number").isin(*wanted)).groupBy("cohort_date").agg(
        *[F.count_if(F.col("day_number") == d).alias(f"_d{d}") for d in wanted]
    )
    rows = F.array(
        *[
            F.struct(F.lit(int(d)).alias("day_number"), F.col(f"_d{int(d)}").alias("_active"))
            for d in days
        ]
    )
    exploded = per_cohort.select("cohort_date", F.col("_d0").alias("cohort_size"), F.inline(rows))
    mature = F.date_add("cohort_date", F.col("day_number")) <= cutoff
    staged = exploded.select(
        "cohort_date",
        F.col("day_number").cast("int").alias("day_number"),
        "cohort_size",
        F.when(mature, F.col("cohort_size")).otherwise(F.lit(0)).cast("bigint").alias("mature_players"),
        F.when(mature, F.col("_active")).otherwise(F.lit(0)).cast("bigint").alias("retained_players"),
    )
    return staged.select(
        "*",
        (F.col("cohort_size") - F.col("mature_players")).alias("censored_players"),
        F.when(
            F.col("mature_players") > 0,
            F.col("retained_players").cast("double") / F.col("mature_players"),
        ).alias("retention_rate"),
    )


def totals_frame(visible: DataFrame, member_df: DataFrame) -> DataFrame:
    """Members LEFT JOIN visible, as counts. Visible events are
    pre-aggregated per player before joining the (unique) members."""
    per_player = visible.groupBy("player_id").agg(
        F.count("event_id").alias("n_events"), F.count_if(F.col("is_late")).alias("n_late")
    )
    j = member_df.join(per_player, "player_id", "left")
    return j.agg(
        F.count_distinct("player_id").alias("cohort_players"),
        F.coalesce(F.sum("n_events"), F.lit(0)).cast("bigint").alias("events"),
        F.coalesce(F.sum("n_late"), F.lit(0)).cast("bigint").alias("late_events"),
    )


def cohort_frames(
    silver: DataFrame,
    cutoff: Column,
    *,
    start=None,
    end=None,
    platform=None,
    version=None,
    days: Sequence[int] = RETENTION_DAYS,
) -> tuple[DataFrame, DataFrame]:
    """Lazy (retention, totals) for a cutoff Column (literal or 1-row value)."""
    vis = visible_events(silver, cutoff)
    mem = members(vis, start, end, platform, version)
    return retention_frame(vis, mem, cutoff, days), totals_frame(vis, mem)


def cohort_review(
    silver: DataFrame,
    *,
    start: dt.date | None = None,
    end: dt.date | None = None,
    platform: str | None = None,
    version: str | None = None,
    as_of: dt.date | None = None,
    days: Sequence[int] = RETENTION_DAYS,
) -> CohortReview:
    """K1-K14. One small action resolves the watermark; everything else is one
    consistent lazy snapshot derived from ``silver`` (K12). Persist or read a
    committed silver version first to pin the snapshot."""
    validate_filters(start, end, platform, version)
    available = watermark(silver).first()["available_through"]
    if as_of is not None and available is not None and as_of > available:
        raise ValueError(f"events are only known through {available}")
    cutoff_value = as_of or available
    cutoff = F.lit(cutoff_value).cast("date")
    retention, totals = cohort_frames(
        silver, cutoff, start=start, end=end, platform=platform, version=version, days=days
    )
    given = {
        "cohort_start": F.lit(start).cast("date"),
        "cohort_end": F.lit(end).cast("date"),
        "acquisition_platform": F.lit(platform).cast("string"),
        "acquisition_version": F.lit(version).cast("string"),
        "definition": F.lit(DEFINITION),
    }
    header = watermark(silver).select(
        F.lit(1).alias("schema_version"),
        F.coalesce(F.lit(as_of).cast("date"), "available_through").alias("as_of"),
        "available_through",
        *(value.alias(name) for name, value in given.items()),
    )
    return CohortReview(header=header, totals=totals, retention=retention.orderBy("cohort_date", "day_number"))
