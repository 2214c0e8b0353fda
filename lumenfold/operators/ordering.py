"""Per-player ordered scans that do not funnel a hot player into one task.

A window ``PARTITION BY player_id`` sends every row of a player to a single
task; if one player holds a third of all rows that task does a third of the
work. Here the ordered scan runs per (player, time bucket) -- a hot player is
spread over as many tasks as it has buckets -- and only a per-bucket summary
(one row per player and bucket) is ordered per player to carry state
(row counts, last event time, session counts) across bucket edges.

A bucket that is still too full at the narrowest width (a burst within one
second) is cut at quantiles of (time, id): ``bucket_plan`` measures both, and the
pieces (``PIECE``) then play the part of buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.timeutil import minute_diff

DEFAULT_BUCKET_SECONDS = 86400  # one UTC day per bucket
#: Widths that bucket_width chooses from.
BUCKET_WIDTHS = (86400, 3600, 60, 1)
#: Rows of one (player, bucket) that a task may order.
BUCKET_ROWS = 2_000_000
BUCKET = "_bucket"
#: Place of a row's piece within its bucket, 0 where the bucket is whole.
PIECE = "_piece"
#: Sampled rows between two cuts of a bucket.
CUT_SAMPLES = 40


@dataclass(frozen=True)
class BucketPlan:
    """Width of the buckets, and the cuts of those too full at that width: (key, bucket, cuts by (time, id))."""

    seconds: int = DEFAULT_BUCKET_SECONDS
    cuts: DataFrame | None = None

    @property
    def columns(self) -> list[str]:
        """What tells the pieces of a key apart, in order."""
        return [BUCKET] if self.cuts is None else [BUCKET, PIECE]


def with_bucket(df: DataFrame, time_col: str = "event_time", bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    return df.withColumn(BUCKET, F.floor(F.unix_seconds(F.col(time_col)) / bucket_seconds))


def _with_pieces(df: DataFrame, plan: BucketPlan, key: str, time_col: str, tie_col: str) -> DataFrame:
    """``df`` with the plan's columns; rows in (time, id) order have them in order too."""
    rows = with_bucket(df, time_col, plan.seconds)
    if plan.cuts is None:
        return rows
    here = F.struct(F.col(time_col), F.col(tie_col))
    passed = F.size(F.filter("_cuts", lambda c: c <= here))
    joined = rows.join(plan.cuts.withColumnRenamed("_key", key), [key, BUCKET], "left")
    return joined.withColumn(PIECE, F.when(F.col("_cuts").isNull(), 0).otherwise(passed)).drop("_cuts")


def bucket_plan(
    df: DataFrame, key: str = "player_id", time_col: str = "event_time", tie_col: str = "event_id",
    max_rows: int = BUCKET_ROWS,
) -> BucketPlan:
    """Buckets of about ``max_rows`` rows or fewer, however the rows of a key are spread over time.

    The width is ``bucket_width``'s. Only if buckets are too full at the narrowest
    width are their cuts taken, from a sample of ``CUT_SAMPLES`` rows a piece, drawn by
    a hash of time and id. Results are the same for any plan.
    """
    width = bucket_width(df, key, time_col, max_rows)
    if width > BUCKET_WIDTHS[-1]:
        return BucketPlan(width)
    rows = with_bucket(df.select(key, time_col, tie_col), time_col, width)
    full = rows.groupBy(key, BUCKET).agg(F.count("*").alias("_n")).where(F.col("_n") > max_rows)
    if full.isEmpty():
        return BucketPlan(width)
    wanted = F.ceil(F.col("_n") / max_rows) * CUT_SAMPLES
    drawn = rows.join(full, [key, BUCKET]).where(F.pmod(F.xxhash64(time_col, tie_col), F.col("_n")) < wanted)
    samples = drawn.groupBy(key, BUCKET).agg(F.array_sort(F.collect_list(F.struct(time_col, tie_col))).alias("_s"))
    places = F.sequence(F.lit(CUT_SAMPLES), F.greatest(F.size("_s"), F.lit(CUT_SAMPLES)), F.lit(CUT_SAMPLES))
    cuts = F.filter(F.transform(places, lambda i: F.get("_s", i - 1)), lambda c: c.isNotNull())
    return BucketPlan(width, samples.select(F.col(key).alias("_key"), BUCKET, cuts.alias("_cuts")).checkpoint(eager=True))


def bucket_width(
    df: DataFrame, key: str = "player_id", time_col: str = "event_time", max_rows: int = BUCKET_ROWS
) -> int:
    """The widest of BUCKET_WIDTHS with ``max_rows`` rows or fewer in every (key, bucket).

    Results are the same at any width; this only keeps the buckets of a very
    busy player small. The narrowest is taken where all others are too full
    (``bucket_plan`` then cuts its buckets).
    One partial aggregate of two columns per width looked at; one number
    reaches the driver.
    """
    for width in BUCKET_WIDTHS[:-1]:
        counts = with_bucket(df.select(key, time_col), time_col, width).groupBy(key, BUCKET).count()
        if (counts.agg(F.max("count")).first()[0] or 0) <= max_rows:
            return width
    return BUCKET_WIDTHS[-1]


def _plan(buckets: int | BucketPlan) -> BucketPlan:
    return buckets if isinstance(buckets, BucketPlan) else BucketPlan(buckets)


def _fine_window(plan: BucketPlan, key: str, time_col: str, tie_col: str):
    return Window.partitionBy(key, *plan.columns).orderBy(time_col, tie_col)


def _summary_window(plan: BucketPlan, key: str):
    return Window.partitionBy(key).orderBy(*plan.columns)


def add_sequence(
    df: DataFrame,
    out_col: str = "event_sequence",
    key: str = "player_id",
    time_col: str = "event_time",
    tie_col: str = "event_id",
    bucket_seconds: int | BucketPlan = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """``row_number() OVER (PARTITION BY key ORDER BY time, tie)`` as bigint."""
    plan = _plan(bucket_seconds)
    b = _with_pieces(df, plan, key, time_col, tie_col)
    local = b.withColumn("_local_rn", F.row_number().over(_fine_window(plan, key, time_col, tie_col)))
    narrow = _with_pieces(df.select(key, time_col, tie_col), plan, key, time_col, tie_col)
    counts = narrow.groupBy(key, *plan.columns).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        key,
        *plan.columns,
        F.coalesce(
            F.sum("_n").over(_summary_window(plan, key).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_offset"),
    )
    return (
        local.join(offsets, [key, *plan.columns], "inner")
        .withColumn(out_col, (F.col("_offset") + F.col("_local_rn")).cast("bigint"))
        .drop("_offset", "_local_rn", *plan.columns)
    )


def _cut_fragments(df: DataFrame, plan: BucketPlan, gap_minutes: int, key: str, time_col: str, tie_col: str) -> DataFrame:
    """``df`` with BUCKET, PIECE and ``_frag``: gaps of the same piece passed so far."""
    fine = _fine_window(plan, key, time_col, tie_col)
    prev = F.lag(time_col).over(fine)
    begins = F.when(prev.isNotNull() & (minute_diff(prev, F.col(time_col)) >= gap_minutes), 1).otherwise(0)
    rows = _with_pieces(df, plan, key, time_col, tie_col).withColumn("_inner_begin", begins)
    passed = F.sum("_inner_begin").over(fine.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_frag", passed).drop("_inner_begin")


def session_fragments(
    df: DataFrame,
    gap_minutes: int,
    aggs: dict[str, Column],
    out_col: str = "session_number",
    key: str = "player_id",
    time_col: str = "event_time",
    tie_col: str = "event_id",
    bucket_seconds: int | BucketPlan = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """Session *fragments* with their per-player session number.

    A fragment is the part of one session inside one (player, bucket, piece). Rows
    are shuffled once by these and scanned in (time, tie) order to cut fragments at
    inner gaps; ``aggs`` (partial aggregates, e.g. counts) are folded per fragment
    right there, so no further stage touches rows. Fragments are then ordered per
    player: a fragment starts a session unless it is the first of its piece and the
    previous piece's last event is less than ``gap_minutes`` minute boundaries
    earlier. The number of fragments per player is bounded by its time span / gap
    plus its number of pieces, not by its event volume, so even a player with a
    third of all rows stays small here. Output: key, bucket, piece, ``_frag``,
    ``_first``, ``_last``, the ``aggs`` columns and ``out_col``.
    """
    plan = _plan(bucket_seconds)
    local = _cut_fragments(df, plan, gap_minutes, key, time_col, tie_col)
    # Same clustering as the window: no exchange for this aggregate.
    frags = local.groupBy(key, *plan.columns, "_frag").agg(
        F.min(time_col).alias("_first"),
        F.max(time_col).alias("_last"),
        *[expr.alias(name) for name, expr in aggs.items()],
    )
    fw = Window.partitionBy(key).orderBy(*plan.columns, "_frag")
    prev_last = F.lag("_last").over(fw)
    begins = F.when(
        (F.col("_frag") > 0) | prev_last.isNull() | (minute_diff(prev_last, F.col("_first")) >= gap_minutes), 1
    ).otherwise(0)
    return frags.withColumn("_begins", begins).withColumn(
        out_col, F.sum("_begins").over(fw.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")
    ).drop("_begins")


def add_session_number(
    df: DataFrame,
    gap_minutes: int,
    out_col: str = "session_number",
    key: str = "player_id",
    time_col: str = "event_time",
    tie_col: str = "event_id",
    bucket_seconds: int | BucketPlan = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """Per-row running count of session starts per player in (time, tie) order
    (a row starts a session when it is the player's first row or when >=
    ``gap_minutes`` minute boundaries separate it from the previous row).

    Rows keep their partitioning; only the fragment numbers (small) move to meet them."""
    plan = _plan(bucket_seconds)
    local = _cut_fragments(df, plan, gap_minutes, key, time_col, tie_col)
    numbers = session_fragments(
        df.select(key, time_col, tie_col), gap_minutes, {}, out_col, key, time_col, tie_col, bucket_seconds
    ).select(key, *plan.columns, "_frag", out_col)
    return local.join(numbers, [key, *plan.columns, "_frag"], "inner").drop("_frag", *plan.columns)
