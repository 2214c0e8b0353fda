"""Several writers of one warehouse, the index of event ids, snapshots, digests, keyed violations."""

from __future__ import annotations

import os
import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from conftest import canonical, lines_df, write_text
from lumenfold.operators.audit import constraint_violations
from lumenfold.plans import ids as I
from lumenfold.plans.commits import CommitLog, put_if_absent
from lumenfold.plans.warehouse import BatchConflictError, Warehouse, verify_export
from lumenfold.schema import BRONZE, GOLD_TABLES
from lumenfold.sources import ndjson
from lumenfold.sources.ndjson import file_digests, lines_digest, read_ndjson
from lumenfold.streaming.file_ingest import start_ndjson_ingest


def new_wh(spark, workdir):
    return Warehouse(spark, os.path.join(workdir, "wh")).initialize()


def batch(spark, make, numbers, name):
    return lines_df(spark, [canonical(make(n)) for n in numbers], name)


# -- commit log ------------------------------------------------------------------


def test_one_writer_creates_a_name(spark, workdir):
    path = f"{workdir}/only"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda n: put_if_absent(spark, path, str(n)), range(8)))
    assert sum(won) == 1 and open(path).read() == str(won.index(True))
    assert [n for n in os.listdir(workdir) if n.startswith("_draft")] == []


def test_log_numbers(spark, workdir):
    log = CommitLog(spark, f"{workdir}/log")
    log.create()
    assert log.last() == 0 and log.entries().count() == 0
    assert log.add(1, "a", "x") and not log.add(1, "b", "y") and log.add(2, "b", "y")
    assert log.last() == 2
    assert [tuple(r) for r in log.entries(1).collect()] == [(1, "a", "x")]


def test_writers_of_one_batch_leave_one_receipt(spark, workdir, make):
    wh = new_wh(spark, workdir)
    lines = batch(spark, make, range(1, 5), "b")
    with ThreadPoolExecutor(3) as pool:
        results = list(pool.map(lambda _: wh.ingest_lines(lines, "b", "sum"), range(3)))
    assert sorted(r.already_processed for r in results) == [False, True, True]
    assert {(r.received, r.accepted, r.quarantined) for r in results} == {(4, 4, 0)}
    assert wh.receipts().count() == 1 and wh.bronze().count() == 4


def test_writer_that_comes_second_with_other_bytes_is_refused(spark, workdir, make, monkeypatch):
    wh = new_wh(spark, workdir)
    add, other = wh.commits.add, batch(spark, make, [9], "b")

    def overtaken(number, batch_id, attempt):
        monkeypatch.setattr(wh.commits, "add", add)
        wh.ingest_lines(other, "b", "other")
        return add(number, batch_id, attempt)

    monkeypatch.setattr(wh.commits, "add", overtaken)
    with pytest.raises(BatchConflictError):
        wh.ingest_lines(batch(spark, make, [1], "b"), "b", "sum")
    assert [r.source_sha256 for r in wh.receipts().collect()] == ["other"]
    assert [r.event_id for r in wh.bronze().collect()] == ["evt_" + f"{9:016x}"]


def test_overtaken_writer_finds_the_duplicates_of_the_other(spark, workdir, make, monkeypatch):
    wh = new_wh(spark, workdir)
    add, other = wh.commits.add, batch(spark, make, [1, 2, 3], "other")

    def overtaken(number, batch_id, attempt):
        monkeypatch.setattr(wh.commits, "add", add)
        wh.ingest_lines(other, "other", "o")
        return add(number, batch_id, attempt)

    monkeypatch.setattr(wh.commits, "add", overtaken)
    result = wh.ingest_lines(batch(spark, make, [2, 3, 4, 5], "late"), "late", "l")
    assert (result.accepted, result.quarantined) == (2, 2)
    assert wh.bronze().count() == wh.bronze().select("event_id").distinct().count() == 5
    assert sorted(r.batch_id for r in wh.receipts().collect()) == ["late", "other"]


def test_snapshot_does_not_move(spark, workdir, make):
    wh = new_wh(spark, workdir)
    wh.ingest_lines(batch(spark, make, [1, 2], "a"), "a", "a")
    wh.rebuild()
    pinned = wh.snapshot()
    first = pinned.bronze().count()
    wh.ingest_lines(batch(spark, make, [3], "b"), "b", "b")
    wh.rebuild()
    assert first == pinned.bronze().count() == pinned.silver().count() == 2
    assert pinned.receipts().count() == 1 and wh.receipts().count() == 2 and wh.silver().count() == 3
    assert pinned.snapshot().bronze().count() == 2


# -- index of event ids (B23) -------------------------------------------------------


def held(wh, spark, wanted, few=None):
    every = wh._every_attempt(wh.bronze_path, BRONZE).select("event_id", "batch_id", "attempt_id")
    ids = spark.createDataFrame([(w,) for w in wanted], "event_id string")
    return wh.event_ids.among(ids, wh.event_ids.fresh(wh._attempts())[0], every, few)


def event_id(n):
    return "evt_" + f"{n:016x}"


def test_index_generations_find_every_committed_id(spark, workdir, make, monkeypatch):
    monkeypatch.setattr(I, "MAX_GENERATIONS", 2)
    wh = new_wh(spark, workdir)
    wh.index_every = 1
    for n in range(4):
        wh.ingest_lines(batch(spark, make, range(3 * n + 1, 3 * n + 5), f"b{n}"), f"b{n}", f"s{n}")
    assert wh.bronze().count() == 13  # one id of each batch is the next one's first
    assert wh.event_ids.fresh(wh._attempts())[1] == 0
    _, generations = wh.event_ids._version()
    assert 1 <= len(generations) <= 2
    wanted = [event_id(n) for n in (0, 1, 4, 10, 13, 14)]
    for few in (None, wanted):
        assert sorted(r.event_id for r in held(wh, spark, wanted, few).collect()) == [event_id(n) for n in (1, 4, 10, 13)]
    gone = wh.event_ids.drop_unused()
    assert gone and len(held(wh, spark, wanted).collect()) == 4
    assert spark.sql("SHOW TABLES").count() == 0


def test_large_batches_take_the_join(spark, workdir, make, monkeypatch):
    import lumenfold.plans.warehouse as W

    monkeypatch.setattr(W, "FEW", 2)
    wh = new_wh(spark, workdir)
    wh.ingest_lines(batch(spark, make, range(1, 9), "a"), "a", "a")
    assert wh.index_ids()
    again = wh.ingest_lines(batch(spark, make, range(5, 12), "b"), "b", "b")
    assert (again.accepted, again.quarantined) == (3, 4)


def test_history_is_not_shuffled_and_other_buckets_are_not_read(spark, workdir, make):
    wh = new_wh(spark, workdir)
    wh.ingest_lines(batch(spark, make, range(1, 40), "a"), "a", "a")
    wh.index_ids()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan says which
    try:
        generation = wh.event_ids._generation(*next(iter(wh.event_ids._version()[1].items())))
        wanted = spark.createDataFrame([(event_id(n),) for n in range(99)], "event_id string").distinct()
        plan = generation.join(wanted, "event_id", "left_semi")._jdf.queryExecution().executedPlan().toString()
        one = generation.where(F.col("event_id").isin([event_id(7)]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    history = plan[: plan.index("FileScan")].splitlines()[1:]
    # The first child of the join is the history: no exchange stands between join and scan.
    assert "SortMergeJoin" in plan.splitlines()[0] or "SortMergeJoin" in "".join(history[:2])
    assert not any("Exchange" in line for line in history)
    assert re.search(r"SelectedBucketsCount: 1 out of 16", one)


def test_bucket_count_follows_the_ids():
    assert I.bucket_count(0) == 16 and I.bucket_count(16 * 4_000_000) == 16
    assert I.bucket_count(16 * 4_000_000 + 1) == 32 and I.bucket_count(10**13) == I.MAX_BUCKETS


# -- large files ---------------------------------------------------------------------


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "2000b", "spark.sql.files.openCostInBytes": "0b"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_stream_reads_a_file_in_splits(spark, workdir, make, small_splits):
    source = f"{workdir}/in"
    os.makedirs(source)
    lines = [canonical(make(n)) for n in range(1, 30)]
    write_text(f"{source}/b.ndjson", "\n".join(lines[:20]) + "\n\n{bad\n")
    write_text(f"{source}/a.ndjson", "\r\n".join(lines[18:]) + "\x0bx")
    want, _ = read_ndjson(spark, source, "want")
    assert want.rdd.getNumPartitions() > 4
    wh = new_wh(spark, workdir)
    results: list = []
    start_ndjson_ingest(spark, wh, source, f"{workdir}/ck", results=results).awaitTermination(120)
    (result,) = results
    assert result.source_sha256 == lines_digest(want).first()[0]
    assert (result.received, result.accepted, result.quarantined) == (want.count(), 29, want.count() - 29)
    bad = {r.line_number: r.reason_code for r in wh.quarantine().collect()}
    raw = {r.line_number: r.raw for r in want.collect()}
    assert sorted(raw[n][:4] for n in bad if bad[n] == "invalid_json") == ["x", "{bad"]
    assert [raw[n] for n in sorted(bad) if bad[n] == "duplicate_event"] == lines[18:20]


@pytest.mark.parametrize("most", [0, 100_000])
def test_numbers_by_either_join(spark, workdir, small_splits, monkeypatch, most):
    monkeypatch.setattr(ndjson, "MAX_SPLITS", most)
    path = write_text(f"{workdir}/x.ndjson", "".join(f"line {n}{'  ' * (n % 50)}\n" for n in range(900)))
    lines, bad = read_ndjson(spark, path, "b")
    got = {r.line_number: r.raw.strip() for r in lines.collect()}
    assert got == {n + 1: f"line {n}" for n in range(900)} and bad.count() == 0


def test_numbering_lines_shuffles_no_line(spark, workdir):
    path = write_text(f"{workdir}/x.ndjson", "a\nb\n")
    lines, _ = read_ndjson(spark, path, "b")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "SinglePartition" not in plan


def tree(data: bytes) -> str:
    from hashlib import sha256

    level = [sha256(p).hexdigest() for p in (data[:-1] if data.endswith(b"\n") else data).split(b"\n")]
    for _ in range(2):
        fan = ndjson.DIGEST_FANOUT
        level = [sha256("\n".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
    return sha256("\n".join([str(len(data)), *level]).encode()).hexdigest()


def test_file_digests_do_not_depend_on_splits(spark, workdir, monkeypatch):
    monkeypatch.setattr(ndjson, "DIGEST_FANOUT", 7)
    os.makedirs(f"{workdir}/files")
    datas = {"a": os.urandom(20_000), "b": b"one\ntwo\r\nthree\n", "c": b"\n", "d": b"x" * 3000, "e": b"one\ntwo\r\nthree"}
    for name, data in datas.items():
        with open(f"{workdir}/files/{name}", "wb") as fh:
            fh.write(data)
    want = {name: (len(data), tree(data)) for name, data in datas.items()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("134217728b", "500b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert (spark.read.text(f"{workdir}/files").rdd.getNumPartitions() > 10) == (size == "500b")
        found = file_digests(spark, f"{workdir}/files/*")
        got = {r.path.rsplit("/", 1)[1]: (r.length, r.tree_sha256) for r in found.collect()}
        assert got == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_export_with_one_changed_byte_is_refused(spark, workdir, make):
    wh = new_wh(spark, workdir)
    wh.ingest_lines(batch(spark, make, [1, 2], "a"), "a", "a")
    wh.rebuild()
    out = f"{workdir}/export"
    wh.export(out)
    assert verify_export(spark, out)["checksums"] == "verified"
    folder = f"{out}/gold_sessions.parquet"
    part = next(f"{folder}/{n}" for n in os.listdir(folder) if n.endswith(".parquet"))
    data = bytearray(open(part, "rb").read())
    data[len(data) // 2] ^= 1
    with open(part, "wb") as fh:
        fh.write(data)
    crc = f"{folder}/.{os.path.basename(part)}.crc"
    if os.path.exists(crc):
        with open(crc, "wb") as fh:  # Hadoop's own sum, which stores other than local disks don't keep
            fh.write(b"")
    with pytest.raises(Exception, match="checksum"):
        verify_export(spark, out)


# -- violations with keys (A18) --------------------------------------------------------


def test_violations_name_keys_and_count_all(spark):
    rows = [(n, None if n % 3 == 0 else 1, 5 if n % 2 else -5, n) for n in range(1, 41)] + [(7, 1, 5, 99), (None, 2, 5, 0)]
    table = spark.createDataFrame(rows, "id int, parent int, amount int, same int")
    parents = spark.createDataFrame([(1,)], "pid int")
    got = constraint_violations(
        table, "t", ["id"], primary_key=["id"], not_null=["id", "parent"], max_keys=4,
        checks={"check:amount": F.col("amount") > 0, "check:never": F.lit(True)},
        foreign_keys=[(["parent"], parents, ["pid"], "fk")], generated={"same": F.col("id")},
    )
    by = {}
    for r in got.collect():
        by.setdefault((r.constraint_name, r.violations, r["keys"]), []).append((r.key, r.rows))
    assert {k: sorted(v, key=str) for k, v in by.items()} == {
        ("primary_key:id", 2, 1): [("7", 2)],
        ("not_null:id", 1, 1): [("NULL", 1)],
        ("not_null:parent", 13, 13): [("12", 1), ("15", 1), ("18", 1), ("21", 1)],
        ("check:amount", 20, 20): [("10", 1), ("12", 1), ("14", 1), ("16", 1)],
        ("check:never", 0, 0): [(None, None)],
        ("fk", 1, 1): [("NULL", 1)],
        ("generated:same", 2, 2): [("7", 1), ("NULL", 1)],
    }


# -- refresh (G1) -----------------------------------------------------------------------


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def published(wh):
    return {"silver": wh.silver(), **{t: wh.gold(t) for t in GOLD_TABLES}}


def test_refresh_equals_a_rebuild_and_rewrites_only_changed_dates(spark, workdir, make):
    wh = new_wh(spark, workdir)
    ply = lambda n: f"ply_{n:012d}"

    def offer(name, events):
        wh.ingest_lines(lines_df(spark, [canonical(e) for e in events], name), name, name)

    offer("a", [make(10 * d + p, "level_start" if p else "session_start", day=d, minute=p, player_id=ply(p), properties={"level": 1} if p else {})
                for d in range(4) for p in range(4)])
    first = wh.rebuild()
    steps = [
        # Two players on a new day and, late, one event between others.
        ([make(101, day=6, player_id=ply(1)), make(102, day=6, player_id=ply(9)), make(103, day=2, minute=40, player_id=ply(2))],
         {"2026-08-07", "2026-08-03", "2026-08-04"}),
        # One session less on the 1st: an event that joins it to the day's first.
        ([make(104, day=2, minute=20, player_id=ply(2))], {"2026-08-03", "2026-08-04"}),
        ([make(105, player_id=ply(1))], {"2026-08-01", "2026-08-02", "2026-08-03", "2026-08-04", "2026-08-07"}),
    ]
    for n, (events, dates) in enumerate(steps):
        offer(f"b{n}", events)
        version = wh.refresh()
        assert wh.current_version() == version and wh.manifest(version)["commits"] == n + 2
        assert set(wh._dates_in("silver", version)) == dates
    # Dates that the kept version links survive the clean-up.
    assert wh.drop_versions(keep=1)[0] == first and wh.silver().count() == 21
    seen = {t: spark.createDataFrame(df.collect(), df.schema) for t, df in published(wh).items()}
    wh.rebuild()
    for table, df in published(wh).items():
        assert same(df, seen[table]), table
    wh.refresh()  # of nothing new
    assert wh._dates_in("silver", wh.current_version()) == [] and same(wh.silver(), seen["silver"])


def test_key_of_pseudonyms_is_in_no_plan(spark):
    from lumenfold.functions.hashing import hmac_pads, pseudonymize, pseudonymizer

    secret = "a-key-that-nobody-may-read"
    ids = spark.createDataFrame([("Customer#1",), ("",), (None,), ("é" * 99,)], "name string")
    both = ids.select(pseudonymizer(spark, secret)(F.col("name")).alias("a"), pseudonymize(F.col("name"), secret).alias("b"))
    assert all(r.a == r.b for r in both.collect())
    plan = ids.select(pseudonymizer(spark, secret)(F.col("name")))._jdf.queryExecution().toString()
    inner, outer = hmac_pads(secret)
    assert not any(x.lower() in plan.lower() for x in (secret, secret.encode().hex(), inner, outer))
