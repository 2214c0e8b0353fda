"""File-arrival ingestion through Structured Streaming (one batch per micro-batch)."""

from __future__ import annotations

import os

from conftest import canonical, write_text
from lumenfold.plans.warehouse import Warehouse
from lumenfold.streaming.file_ingest import start_ndjson_ingest


def test_stream_commits_each_micro_batch_once(spark, workdir, make):
    src = os.path.join(workdir, "incoming")
    os.makedirs(src)
    write_text(os.path.join(src, "a.ndjson"), "\n".join(canonical(make(i)) for i in range(1, 4)) + "\n")
    write_text(os.path.join(src, "b.ndjson"), canonical(make(3)) + "\n{bad\n")
    wh = Warehouse(spark, os.path.join(workdir, "wh")).initialize()
    ckpt = os.path.join(workdir, "stream-ckpt")
    results: list = []
    q = start_ndjson_ingest(spark, wh, src, ckpt, results=results)
    q.awaitTermination(120)
    assert len(results) == 1
    r = results[0]
    assert (r.received, r.accepted, r.quarantined) == (5, 3, 2)
    reasons = sorted(x["reason_code"] for x in wh.quarantine().collect())
    assert reasons == ["duplicate_event", "invalid_json"]
    # Re-running the stream finds nothing new: no second batch.
    q2 = start_ndjson_ingest(spark, wh, src, ckpt, results=results)
    q2.awaitTermination(120)
    assert len(results) == 1 and wh.receipts().count() == 1


def test_multi_file_batch_numbers_lines_consecutively(spark, workdir, make):
    from lumenfold.sources.ndjson import lines_from_files

    src = os.path.join(workdir, "multi")
    os.makedirs(src)
    write_text(os.path.join(src, "1.ndjson"), "x\n\ny\n")
    write_text(os.path.join(src, "2.ndjson"), "z\n")
    lines, bad, checksum = lines_from_files(spark.read.format("binaryFile").load(src), "m")
    got = sorted((r["line_number"], r["raw"]) for r in lines.collect())
    assert got == [(1, "x"), (3, "y"), (4, "z")]
    assert bad.count() == 0 and len(checksum.first()["source_sha256"]) == 64
