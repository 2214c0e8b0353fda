"""Bring silver and gold up to new batches by rewriting what they change (G1).

``refresh`` publishes the version that a full rebuild would, but reads the rows
of *touched* players (those with events in batches committed since the current
version) instead of all, and writes only the dates of silver and sessions that
come out different: a new event moves the sequence numbers and sessions of its
player's later events, and nothing else. The other dates are linked: the version's
manifest names, per date, the version whose files hold it. Daily metrics and funnel
are recomputed for changed dates, anomalies for touched players; retention and the
player summary depend on all dates and are derived from silver as in a rebuild.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.timeutil import utc_date
from lumenfold.operators.anomalies import anomalies
from lumenfold.operators.daily import daily_metrics
from lumenfold.operators.funnel import funnel
from lumenfold.operators.ingest import materialize
from lumenfold.operators.ordering import add_sequence, bucket_plan
from lumenfold.operators.players import player_summary
from lumenfold.operators.retention import retention
from lumenfold.operators.sessions import sessions
from lumenfold.operators.silver import silver_columns
from lumenfold.schema import SILVER_COLUMNS
from lumenfold.session import checkpoint_dir


def _dates(rows: DataFrame, date: Column) -> list[dt.date]:
    """The distinct dates of some rows (one number per calendar day at most)."""
    return sorted(r[0] for r in rows.select(date.alias("d")).distinct().collect())


def _swapped(old: DataFrame, new: DataFrame, touched: DataFrame, within: Column) -> DataFrame:
    """Rows ``within``: those of touched players from ``new``, the others from ``old``."""
    return old.where(within).join(touched, "player_id", "left_anti").unionByName(new.where(within))


def refresh(warehouse) -> str:
    """Publish a version that covers every commit; the first one is a full rebuild."""
    pinned = warehouse.snapshot()
    if pinned.current_version() is None:
        return warehouse.rebuild()
    staging = f"{checkpoint_dir(warehouse.spark).rstrip('/')}/lumenfold-refresh-{uuid.uuid4().hex}"
    try:
        return _refresh(warehouse, pinned, staging)
    finally:
        fs, p = warehouse._fs(staging)
        fs.delete(p, True)


def _refresh(warehouse, pinned, staging: str) -> str:
    before = warehouse.manifest(pinned.current_version())
    version = warehouse.new_version()
    new = materialize(silver_columns(pinned.bronze(after=before["commits"])), f"{staging}/new")
    touched = materialize(new.select("player_id").distinct(), f"{staging}/players")

    old = pinned.silver()
    mine = old.join(touched, "player_id", "left_semi")
    both = mine.select(*new.columns).unionByName(new)
    buckets = bucket_plan(both)
    again = materialize(add_sequence(both, bucket_seconds=buckets).select(*SILVER_COLUMNS), f"{staging}/silver")
    place = ["event_id", "event_sequence"]
    moved = again.select(*place, "event_date").join(mine.select(*place), place, "left_anti")
    days = _dates(moved, F.col("event_date"))
    warehouse.write_silver(_swapped(old, again, touched, F.col("event_date").isin(days)), version)
    silver_dates = warehouse.linked("silver", before["dates"]["silver"], days, version)
    s = warehouse.read_dated("silver", silver_dates)

    started = utc_date("session_started_at")
    old_sessions = pinned.gold("gold_sessions")
    my_sessions = old_sessions.join(touched, "player_id", "left_semi")
    new_sessions = materialize(sessions(again, bucket_seconds=buckets), f"{staging}/sessions")
    differ = new_sessions.exceptAll(my_sessions).unionByName(my_sessions.exceptAll(new_sessions))
    starts = _dates(differ, started)
    warehouse.write_sessions(_swapped(old_sessions, new_sessions, touched, started.isin(starts)), version)
    session_dates = warehouse.linked("gold_sessions", before["dates"]["gold_sessions"], starts, version)
    sess = warehouse.read_dated("gold_sessions", session_dates)

    changed = F.col("event_date").isin(sorted({*days, *starts}))
    daily = daily_metrics(s.where(changed), sess.where(started.isin(sorted({*days, *starts}))))
    in_days = F.col("event_date").isin(days)
    odd = pinned.gold("gold_anomaly_candidates").join(touched, "player_id", "left_anti")
    warehouse.write_gold(
        {
            "gold_daily_metrics": pinned.gold("gold_daily_metrics").where(~changed).unionByName(daily),
            "gold_funnel": pinned.gold("gold_funnel").where(~in_days).unionByName(funnel(s.where(in_days))),
            "gold_anomaly_candidates": odd.unionByName(anomalies(again)),
            "gold_retention": retention(s),
            "gold_player_summary": player_summary(s, sess),
        },
        version,
    )
    return warehouse.publish(version, pinned, {"silver": silver_dates, "gold_sessions": session_dates})
