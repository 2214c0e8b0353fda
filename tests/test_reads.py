"""Metric reads, receipts listing, health, canonical NDJSON sink."""

from __future__ import annotations

import json
import os

import pytest

from conftest import canonical, lines_df
from lumenfold.operators import metrics as M
from lumenfold.plans.warehouse import Warehouse
from lumenfold.sources.ndjson import write_ndjson


@pytest.fixture
def wh(spark, workdir, make):
    w = Warehouse(spark, os.path.join(workdir, "wh")).initialize()
    recs = [make(1), make(2, "level_start", minute=1, properties={"level": 2}),
            make(3, "level_complete", minute=2, properties={"level": 2}),
            make(4, "purchase", day=1, properties={"amount_cents": 199, "currency": "USD"}),
            make(5, player_id="ply_000000000002", day=2)]
    w.ingest_lines(lines_df(spark, [canonical(r) for r in recs] + ["{oops"], "b1"), "b1", "sha-1")
    w.rebuild()
    return w


def test_summary_and_health(wh):
    s = wh.metric("summary").first().asDict()
    assert s == {"accepted_events": 5, "players": 2, "late_events": 0, "purchases": 1, "quarantined_events": 1}
    h = wh.health().first()
    assert h["accepted_events"] == 5 and h["latest_batch_completed_at"] is not None


def test_bounded_dispatch_and_identifier_checks(wh):
    assert wh.metric("players", limit=1).count() == 1
    assert wh.metric("anomalies", limit=100).count() >= 0
    tl = wh.metric("timeline", limit=2, player_id="ply_000000000001").collect()
    assert [r["event_id"] for r in tl] == ["evt_0000000000000001", "evt_0000000000000002"]
    assert wh.metric("timeline", player_id="ply_0000000000ff").count() == 0  # well-formed, unknown
    with pytest.raises(ValueError):
        wh.metric("timeline", player_id="not-a-player")
    with pytest.raises(ValueError):
        wh.metric("players", limit=101)
    with pytest.raises(ValueError):
        wh.metric("drop_tables")
    funnel = wh.metric("funnel").collect()
    assert [r["stage_order"] for r in funnel] == [1, 2, 3, 4]


def test_player_summary_values(wh):
    rows = {r["player_id"]: r for r in wh.gold("gold_player_summary").collect()}
    p1 = rows["ply_000000000001"]
    assert (p1["highest_level"], p1["purchases"], p1["revenue_cents"], p1["active_days"]) == (2, 1, 199, 2)
    assert p1["churn_risk"] is False
    daily = {r["event_date"].day: r for r in wh.gold("gold_daily_metrics").collect()}
    assert daily[1]["level_completion_rate"] == 1.0 and daily[2]["level_completion_rate"] is None


def test_receipt_listing(wh):
    rows = wh.receipt_listing().collect()
    assert [(r["batch_id"], r["received_count"], r["accepted_count"], r["quarantine_count"]) for r in rows] == [
        ("b1", 6, 5, 1)
    ]


def test_latest_cohort_and_newest_anomalies_are_bounded(wh):
    assert M.clamp(0, 1, 500) == 1 and M.clamp(10_000, 1, 500) == 500
    latest = M.latest_cohort_retention(wh.gold("gold_retention")).collect()
    assert {r["cohort_date"] for r in latest} == {max(r["cohort_date"] for r in wh.gold("gold_retention").collect())}


def test_canonical_ndjson_sink(spark, workdir):
    df = spark.createDataFrame(
        [("evt_1", 1, ("USD", 5))], "zeta string, alpha int, props struct<currency:string, amount:int>"
    )
    out = os.path.join(workdir, "out")
    write_ndjson(df, out)
    text = "".join(
        open(os.path.join(out, f), encoding="utf-8").read() for f in sorted(os.listdir(out)) if f.startswith("part-")
    )
    line = text.strip()
    assert line == json.dumps(json.loads(line), sort_keys=True, separators=(",", ":"))
    assert line == '{"alpha":1,"props":{"amount":5,"currency":"USD"},"zeta":"evt_1"}'


def test_constraint_audit_and_insert_if_absent(spark):
    from pyspark.sql import functions as F

    from lumenfold.operators.audit import constraint_audit, insert_if_absent

    parent = spark.createDataFrame([(1,), (2,)], "k long")
    child = spark.createDataFrame([(1, 1, 5.0), (1, 2, -1.0), (2, 3, None), (3, None, 1.0)], "id long, k long, v double")
    got = {
        r["constraint_name"]: r["violations"]
        for r in constraint_audit(
            child, "child", primary_key=["id"], not_null=["k"], checks={"check:v>=0": F.col("v") >= 0},
            foreign_keys=[(["k"], parent.withColumnRenamed("k", "pk"), ["pk"], "fk:k")],
        ).collect()
    }
    assert got == {"not_null:k": 1, "check:v>=0": 1, "primary_key:id": 2, "fk:k": 1}
    fresh = insert_if_absent(parent, spark.createDataFrame([(2,), (4,)], "k long"), ["k"])
    assert [r["k"] for r in fresh.collect()] == [4]
