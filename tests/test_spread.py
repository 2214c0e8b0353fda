"""Lines of one row group or one task are built and validated by several."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import ingest
from lumenfold.operators.validate import validate
from lumenfold.sources.adapters import load_raw_lines, raw_event_lines


def one_row_group(folder, rows):
    """An events table whose scan is one task: one file of one row group."""
    start = dt.datetime(2024, 1, 1)
    table = pa.table({
        "event_id": pa.array(range(rows), pa.int64()),
        "ts": pa.array([start + dt.timedelta(seconds=n) for n in range(rows)], pa.timestamp("us")),
        "user_id": pa.array([n % 50 for n in range(rows)], pa.int64()),
        "event_type": [("signup", "view", "click", "purchase", "error")[n % 5] for n in range(rows)],
        "value": [float(n % 90) for n in range(rows)],
        "props": [f'{{"k": {n % 100}}}' for n in range(rows)],
    })
    pq.write_table(table, f"{folder}/events.parquet", row_group_size=rows)
    return folder


@pytest.fixture
def small_partitions(spark):
    name = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(name, "16k")
    yield
    spark.conf.unset(name)


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_lines_of_one_row_group_are_built_by_several_tasks(spark, workdir, small_partitions):
    folder = one_row_group(workdir, 6000)
    lines = load_raw_lines(spark, folder)
    assert tasks(spark.read.parquet(f"{folder}/events.parquet")) == 1
    assert tasks(lines) > 1
    expected = raw_event_lines(spark.read.parquet(f"{folder}/events.parquet"))
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, expected.collect()))


def test_batch_of_one_task_is_validated_by_several(spark, workdir, small_partitions, monkeypatch):
    lines = raw_event_lines(spark.read.parquet(f"{one_row_group(workdir, 6000)}/events.parquet"))
    seen, write = [], ingest.materialize

    def staged(df, location=None):
        seen.append(spark.conf.get(ingest.HUGE_METHOD_CONF))
        return write(df.withColumn("task", F.spark_partition_id()), location)

    monkeypatch.setattr(ingest, "materialize", staged)
    spark.conf.set(ingest.HUGE_METHOD_CONF, "65535")
    try:
        checked = ingest.stage_validated(lines, f"{workdir}/staged")
        assert seen == [ingest.JIT_METHOD_LIMIT] and spark.conf.get(ingest.HUGE_METHOD_CONF) == "65535"
    finally:
        spark.conf.set(ingest.HUGE_METHOD_CONF, "8000")
    assert checked.select("task").distinct().count() > 1
    assert checked.count() == lines.count()
    plain = validate(lines)
    assert sorted(map(repr, checked.drop("task").collect())) == sorted(map(repr, plain.collect()))


def test_a_filter_by_line_number_comes_before_lines_are_built(spark, workdir):
    folder = one_row_group(workdir, 600)
    lines = load_raw_lines(spark, folder)
    part = lines.where(F.shiftright(F.col("line_number") - 1, 1) % 3 == 0)
    plan = part._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("date_format") < plan.index("% 3")  # operators are listed from the last to the first
    rows = {(r["line_number"], r["raw"]) for r in lines.collect()}
    assert len(rows) == 600 + len(range(0, 600, 73))
    assert {tuple(r) for r in part.select("line_number", "raw").collect()} == {r for r in rows if (r[0] - 1) // 2 % 3 == 0}
