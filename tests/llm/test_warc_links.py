"""Transactions over archives whose records name each other in every way; partitioned and empty pages."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import warc
from lumenfold.llm.queries import QUERIES


def record(kind, own, *named, block="b"):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{own}>", *(f"WARC-Concurrent-To: <{n}>" for n in named)]
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}", "", block]) + "\r\n\r\n"


ARCHIVE = [
    record("response", "A", "r1", block="HTTP/1.1 200 OK\r\n\r\nbody"), record("request", "r1", block="one"),
    record("request", "r2", "A", block="two"), record("metadata", "m1", "r1", block="of r1"),
    record("metadata", "m2", "m1", block="of m1"), record("metadata", "m2", "m1", block="of m1"),
    record("revisit", "B", "C"), record("response", "C"), record("request", "r3", "C", "B"),
    record("request", "lost", "nowhere"), record("metadata", "alone"), record("response", "D"),
    record("warcinfo", "w", "D"),
]


def test_links_of_either_side_and_through_others(spark, workdir):
    with open(f"{workdir}/x.warc", "w", newline="") as fh:
        fh.write("".join(ARCHIVE))
    rows = {r.response.id: r for r in warc.transactions(spark, f"{workdir}/x.warc").collect()}
    ids = lambda records: [r.id for r in records]
    assert {k: (ids(r.requests), ids(r.metadata)) for k, r in rows.items()} == {
        "<A>": (["<r1>", "<r2>"], ["<m1>", "<m2>"]), "<B>": (["<r3>"], []), "<C>": (["<r3>"], []), "<D>": ([], []),
    }
    assert bytes(rows["<A>"].payload) == b"body" and [bytes(r.block) for r in rows["<A>"].requests] == [b"one", b"two"]


@pytest.mark.parametrize("folders", [False, True])
def test_query_over_one_file_and_over_folders_of_equal_file_names(spark, workdir, folders):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    parts = pages.withColumn("half", F.col("page_id") % 2)
    sf = f"{workdir}/sf"
    if folders:
        for half in (0, 1):  # one write each, so that both folders hold the same file name
            path = f"{workdir}/{half}"
            parts.where(F.col("half") == half).drop("half").coalesce(1).write.parquet(path)
            import glob
            import os
            import shutil

            target = f"{sf}/pages.parquet/half={half}"
            os.makedirs(target)
            shutil.copy(glob.glob(f"{path}/*.parquet")[0], f"{target}/part.parquet")
    else:
        pages.write.parquet(f"{sf}/pages.parquet")
    got = QUERIES["op5_warc"](spark, sf)
    assert got.dtypes == [
        ("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint"),
    ]
    payloads = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    largest = {}
    for i, p in sorted(payloads.items()):
        largest[p] = i
    want = []
    for i, p in payloads.items():
        again = len(p) >= 1000 and largest[p] != i
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", largest[p] if again else None))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_pages(spark, workdir):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").where("page_id is null")
    pages.write.parquet(f"{workdir}/pages.parquet")
    assert QUERIES["op5_warc"](spark, workdir).count() == 0
