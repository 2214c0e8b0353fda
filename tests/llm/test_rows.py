"""Columns of any type and name through the pipeline's row filters; false finds of the secret scan on unlike text."""

from __future__ import annotations

import datetime as dt
import re
import sysconfig
from pathlib import Path

from pyspark.sql import functions as F

from lumenfold.llm import secrets, simhash


def test_keep_one_with_maps_dotted_names_and_repeated_rows(spark):
    text = "one two three four five six seven"
    rows = [(1, text, {"k": 1}, dt.date(2026, 1, 1)), (1, text, {"k": 2}, None), (2, text, None, None), (3, "another text here", {}, None), (3, "another text here", {}, None), (None, None, {"z": 0}, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` map<string,int>, _row date")
    got = simhash.keep_one(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    kept = sorted(map(str, got.collect()))
    assert len(kept) == 3 and sum("doc_id=1" in k for k in kept) == sum("doc_id=3" in k for k in kept) == 1


def test_few_ordinary_runs_of_unlike_text_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    table = secrets.train(docs)
    files = sorted(Path(sysconfig.get_path("stdlib")).glob("*.py"))[:60]
    runs = sorted({r for f in files for r in re.findall(r"[A-Za-z0-9+/_=-]{12,}", f.read_text(errors="replace"))})
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "doc_id long, text string")
    found = secrets.scan(frame, table).where(secrets.count_kind(F.col("spans"), "random") > 0).count()
    assert len(runs) > 3000 and found < 0.015 * len(runs)
