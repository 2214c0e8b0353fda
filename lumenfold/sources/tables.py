"""Driver-table scans with explicit column pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt evenly over tasks. A scan gives a Parquet row group or an
    unsplittable file to one task, however many rows it has; what costs far more per row
    than a shuffle should not stay there. AQE sizes the partitions by their bytes, so
    small input stays in few and large input gets many."""
    return df.hint("rebalance")
