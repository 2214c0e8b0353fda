"""Incremental ingestion of arriving NDJSON files with Structured Streaming.

The stream reads text, so a file of any size is read by as many tasks as it has
splits; each line carries its file and split, from which the micro-batch numbers
its lines as a batch read of the same files does. Every micro-batch is committed
as one ingest batch through ``foreachBatch``: the batch id is derived from the
stream's epoch id and the checksum from the lines, so a micro-batch that Spark
replays after a failure either finds its receipt (``already_processed``, nothing
rewritten) or redoes the half-written batch as a new attempt, of which the
receipt shows one. Together with the stream's checkpoint this gives exactly-once
batches. A micro-batch of files without a line commits nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lumenfold.plans.warehouse import IngestionResult, Warehouse
from lumenfold.sources.ndjson import located


def micro_batch_id(prefix: str, epoch_id: int) -> str:
    return f"{prefix}-{epoch_id:012d}"


def start_ndjson_ingest(
    spark: SparkSession,
    warehouse: Warehouse,
    source_dir: str,
    checkpoint_location: str,
    batch_prefix: str = "stream",
    strict: bool = False,
    available_now: bool = True,
    processing_time: str | None = None,
    max_files_per_trigger: int | None = None,
    results: list | None = None,
) -> StreamingQuery:
    """Start the stream. ``available_now`` processes what is present and stops;
    otherwise ``processing_time`` (e.g. "1 minute") keeps it running.
    ``checkpoint_location`` must be on shared storage."""
    reader = spark.readStream.option("pathGlobFilter", "*.ndjson")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = located(reader.text(source_dir))

    def commit(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        result: IngestionResult = warehouse.ingest_text(batch, micro_batch_id(batch_prefix, epoch_id), strict)
        if results is not None:
            results.append(result)

    writer = lines.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint_location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
