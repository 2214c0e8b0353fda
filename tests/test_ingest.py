"""Ingest integration: routing, replay, conflict, strict inputs, atomicity (A*)."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from conftest import canonical, lines_df, write_text
from lumenfold.plans.warehouse import (
    AdmissionLimits,
    BatchConflictError,
    InputRefused,
    Warehouse,
    check_batch_id,
)
from lumenfold.operators.audit import insert_if_absent
from lumenfold.sources.ndjson import read_ndjson, split_lines, write_ndjson


def new_wh(spark, workdir, **kw):
    return Warehouse(spark, os.path.join(workdir, "wh"), **kw).initialize()


def test_shape_errors_are_preserved(spark, workdir):
    wh = new_wh(spark, workdir)
    path = write_text(os.path.join(workdir, "invalid.ndjson"), "{bad json}\n[1,2,3]\n\n")
    result = wh.ingest_ndjson(path, "invalid-lines")
    assert (result.received, result.accepted, result.quarantined) == (2, 0, 2)
    reasons = [r["reason_code"] for r in wh.quarantine().orderBy("line_number").collect()]
    assert reasons == ["invalid_json", "invalid_shape"]


def test_replay_and_conflict(spark, workdir, make):
    wh = new_wh(spark, workdir)
    path = write_text(os.path.join(workdir, "a.ndjson"), "\n".join(canonical(make(i)) for i in range(1, 4)) + "\n")
    first = wh.ingest_ndjson(path, "batch-a")
    assert (first.received, first.accepted, first.quarantined, first.already_processed) == (3, 3, 0, False)
    replay = wh.ingest_ndjson(path, "batch-a")
    assert replay.already_processed and wh.bronze().count() == 3
    other = write_text(os.path.join(workdir, "b.ndjson"), canonical(make(9)) + "\n")
    with pytest.raises(BatchConflictError):
        wh.ingest_ndjson(other, "batch-a")


def test_duplicates_across_batches_and_privacy(spark, workdir, make):
    wh = new_wh(spark, workdir)
    clean = [canonical(make(i, minute=i)) for i in range(1, 5)]
    leaky = make(10)
    leaky["properties"] = {"email": "someone@example.test"}
    text = "\n".join(clean + [canonical(leaky), "{broken"]) + "\n"
    result = wh.ingest_ndjson(write_text(os.path.join(workdir, "p.ndjson"), text), "privacy")
    assert (result.received, result.accepted, result.quarantined) == (6, 4, 2)
    again = wh.ingest_ndjson(write_text(os.path.join(workdir, "q.ndjson"), clean[0] + "\n"), "second")
    assert (again.accepted, again.quarantined) == (0, 1)
    assert wh.quarantine().filter(F.col("batch_id") == "second").first()["reason_code"] == "duplicate_event"


def test_batch_identifier_is_bounded():
    with pytest.raises(ValueError, match="batch_id"):
        check_batch_id("")
    with pytest.raises(ValueError, match="batch_id"):
        check_batch_id("x" * 81)
    with pytest.raises(ValueError):
        check_batch_id("../path", strict=True)


@pytest.mark.parametrize(
    "text",
    ['{"event_id":"a","event_id":"b"}\n', '{"x": NaN}\n', "[]\n"],
)
def test_strict_input_refusals(spark, workdir, text):
    wh = new_wh(spark, workdir)
    with pytest.raises(InputRefused):
        wh.ingest_ndjson(write_text(os.path.join(workdir, "s.ndjson"), text), "strict-1", strict=True)
    assert wh.receipts().count() == 0


def test_admission_limits(spark, workdir, make):
    wh = new_wh(spark, workdir, limits=AdmissionLimits(max_input_rows=2))
    text = "\n".join(canonical(make(i)) for i in range(1, 4)) + "\n"
    with pytest.raises(InputRefused):
        wh.ingest_ndjson(write_text(os.path.join(workdir, "l.ndjson"), text), "too-many")


def test_uncommitted_batch_is_invisible(spark, workdir, make):
    wh = new_wh(spark, workdir)
    wh.ingest_lines(lines_df(spark, [canonical(make(1))], "ok"), "ok", "x")
    leave_attempt(wh, "crashed")
    assert wh.bronze().count() == 1


def leave_attempt(wh, batch_id):
    """What an attempt leaves that stopped before its receipt: a bronze partition."""
    stray = wh.bronze().limit(1).withColumns({"batch_id": F.lit(batch_id), "attempt_id": F.lit("stopped")})
    stray.write.mode("append").partitionBy("batch_id", "attempt_id").parquet(wh.bronze_path)


def test_retry_that_accepts_nothing_shows_no_rows_of_the_stopped_attempt(spark, workdir, make):
    wh = new_wh(spark, workdir)
    line = canonical(make(1))
    wh.ingest_lines(lines_df(spark, [line], "y"), "y", "sum-y")
    leave_attempt(wh, "x")
    again = wh.ingest_lines(lines_df(spark, [line], "x"), "x", "sum-x")
    assert (again.accepted, again.quarantined) == (0, 1)
    assert [r.batch_id for r in wh.bronze().collect()] == ["y"]
    assert wh.audit().agg(F.sum("violations")).first()[0] == 0


def test_second_batch_keeps_the_first_under_static_overwrite(spark, workdir, make):
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "static")
    try:
        wh = new_wh(spark, workdir)
        for n, name in enumerate(("a", "b"), 1):
            wh.ingest_lines(lines_df(spark, [canonical(make(n)), "{"], name), name, name)
        assert sorted(r.batch_id for r in wh.receipts().collect()) == ["a", "b"]
        assert wh.bronze().count() == 2 and wh.quarantine().count() == 2
    finally:
        spark.conf.set(mode, before)


def test_files_and_records_with_the_same_lines_have_the_same_checksum(spark, workdir):
    rows = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(1, 8)], "n int, s string")
    path = os.path.join(workdir, "lines")
    write_ndjson(rows.coalesce(1).orderBy("n"), path)
    wh = new_wh(spark, workdir)
    from_files, from_records = wh.ingest_ndjson(path, "f"), wh.ingest_records(rows, "r", ["n"])
    assert from_files.source_sha256 == from_records.source_sha256
    assert '"s":null' in wh.quarantine().where("line_number = 1").first().raw_payload


def test_file_lines_are_numbered_across_splits_and_separators(spark, workdir):
    text = "".join(f"line {i}" + ("\n", "\r\n", "\x0b", "\u2028", "\n\n")[i % 5] for i in range(400)) + "end\n"
    text += "plain\n" * 500  # splits without the rarer separators
    for name in ("b", "a"):
        write_text(os.path.join(workdir, f"{name}.ndjson"), text)
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "500b")
    try:
        lines, bad = read_ndjson(spark, f"{workdir}/*.ndjson", "n")
        got = [(r.line_number, r.raw) for r in lines.orderBy("line_number").collect()]
        assert spark.read.text(f"{workdir}/*.ndjson").rdd.getNumPartitions() > 4 and bad.isEmpty()
    finally:
        spark.conf.set(size, before)
    want = [(n, x) for n, x in enumerate((text + text).splitlines(), 1) if x.strip()]
    assert got == want


def test_insert_if_absent_takes_a_key_once(spark):
    have, come = (spark.createDataFrame([(k, v) for k, v in rows], "k int, v string") for rows in ([(1, "a")], [(1, "b"), (2, "c"), (2, "d")]))
    assert [r.k for r in insert_if_absent(have, come, ["k"]).collect()] == [2]


def test_splitlines_parity(spark):
    text = "a\nb\r\nc\rd\x0be\x0cf\x1cg\x1dh\x1ei\x85j k l\n\n m \n"
    got = spark.createDataFrame([(text,)], "text string").select(split_lines("text").alias("x")).first()["x"]
    assert got == text.splitlines()


def test_ingest_records_checksum_is_content_defined(spark, workdir, make):
    wh = new_wh(spark, workdir)
    recs = spark.createDataFrame([(f"evt_{i:016x}", i) for i in range(1, 6)], "event_id string, n int")
    a = wh.ingest_records(recs, "recs", ["n"])
    assert a.received == 5 and a.quarantined == 5
    b = wh.ingest_records(recs.orderBy(F.desc("n")), "recs", ["n"])
    assert b.already_processed and b.source_sha256 == a.source_sha256


def test_payloads_are_whole_unless_bounded(spark, workdir, make):
    line = canonical(make(1)) + " " * 30_000
    for chars, expected in ((None, len(line)), (20_000, 20_000)):
        wh = Warehouse(spark, os.path.join(workdir, str(chars)), payload_chars=chars).initialize()
        wh.ingest_lines(lines_df(spark, [line, "x" * 30_000], "a"), "a", "sum")
        assert len(wh.bronze().first().raw_payload) == expected
        assert len(wh.quarantine().first().raw_payload) == min(30_000, expected)


def test_committed_batch_does_not_see_itself_as_duplicate(spark, workdir, make):
    wh = new_wh(spark, workdir)
    first = wh.ingest_lines(lines_df(spark, [canonical(make(n)) for n in (1, 2, 2)], "a"), "a", "sum-a")
    second = wh.ingest_lines(lines_df(spark, [canonical(make(n)) for n in (2, 3, 3, 4)], "b"), "b", "sum-b")
    assert (first.accepted, first.quarantined) == (2, 1)
    assert (second.accepted, second.quarantined) == (2, 2)
    assert wh.bronze().count() == 4
