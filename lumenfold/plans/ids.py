"""Index of committed event ids (B23): which ids of a batch does history hold?

Ids stand in *generations*: Parquet files bucketed by the id's hash and sorted by
id, with a Bloom filter per bucket file. A generation is written once from the
batches committed since the one before, and never changed; a version (a small
marker file) names the generations in use. Batches newer than the version are
read from their own partitions of bronze, ids only.

Looking up a batch never shuffles history: the generation's buckets are its
partitioning, so only the batch's ids are dealt to them (or broadcast while
small). A batch of at most ``FEW`` ids is looked up by its literal ids, which
lets the scan open their buckets alone and skip row groups by Bloom filter.
Generations are merged bucket by bucket when there are more than
``MAX_GENERATIONS``. The number of buckets follows the number of ids.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.plans.commits import _fs, put_if_absent, read_text

FEW = 1000
MAX_GENERATIONS = 8
IDS_PER_BUCKET = 4_000_000
MIN_BUCKETS = 16
MAX_BUCKETS = 65_536
ATTEMPT_KEY = ("batch_id", "attempt_id")


def bucket_count(rows: int) -> int:
    """Buckets for so many ids: a power of two, about ``IDS_PER_BUCKET`` ids each."""
    wanted = max(MIN_BUCKETS, -(-rows // IDS_PER_BUCKET))
    return min(MAX_BUCKETS, 1 << (wanted - 1).bit_length())


class EventIds:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.versions = f"{root}/_versions"

    def create(self) -> None:
        fs, p = _fs(self.spark, self.versions)
        fs.mkdirs(p)

    def _version(self) -> tuple[int, dict[str, int]]:
        """(newest version, its generations with their bucket counts)."""
        fs, p = _fs(self.spark, self.versions)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return 0, {}
        return max(numbers), json.loads(read_text(self.spark, f"{self.versions}/{max(numbers):012d}"))

    def _generation(self, name: str, buckets: int) -> DataFrame:
        """The ids of one generation, read with their bucketing.

        Only a catalog entry tells Spark about buckets, so one is made for the
        read and dropped (its files stay) once the relation is resolved.
        """
        table = f"lumenfold_ids_{uuid.uuid4().hex}"
        place = f"{self.root}/{name}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE {table} (event_id STRING) USING parquet"
            f" CLUSTERED BY (event_id) SORTED BY (event_id) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
        try:
            return self.spark.table(table)
        finally:
            self.spark.sql(f"DROP TABLE {table}")

    def _write(self, ids: DataFrame, buckets: int) -> str:
        name = f"ids-{uuid.uuid4().hex}"
        table = f"lumenfold_{name.replace('-', '_')}"
        spread = ids.repartition(buckets, "event_id").sortWithinPartitions("event_id")
        (
            spread.write.format("parquet").mode("overwrite")
            .option("path", f"{self.root}/{name}")
            .option("parquet.bloom.filter.enabled#event_id", "true")
            .bucketBy(buckets, "event_id").sortBy("event_id").saveAsTable(table)
        )
        self.spark.sql(f"DROP TABLE {table}")
        return name

    def fresh(self, committed: DataFrame) -> tuple[DataFrame, int]:
        """The attempts of ``committed`` that the current version doesn't hold, and their number up to ``FEW`` + 1.

        Few of them are a local table with a broadcast hint: they are what prunes bronze.
        """
        paths = [f"{self.root}/{name}-attempts" for name in self._version()[1]]
        attempts = committed.select(*ATTEMPT_KEY)
        if paths:
            schema = "batch_id string, attempt_id string"
            held = self.spark.read.schema(schema).parquet(*paths)
            attempts = attempts.join(held, list(ATTEMPT_KEY), "left_anti")
        found = attempts.limit(FEW + 1).collect()
        if len(found) > FEW:
            return attempts, len(found)
        return F.broadcast(self.spark.createDataFrame(found, attempts.schema)), len(found)

    def extend(self, committed: DataFrame, bronze: DataFrame) -> bool:
        """Index the attempts of ``committed`` that aren't yet; false if another writer was faster.

        ``bronze`` has the event ids of all attempts with their (batch_id, attempt_id).
        """
        number, generations = self._version()
        fresh, n = self.fresh(committed)
        if not n:
            return True
        ids = bronze.join(fresh, list(ATTEMPT_KEY), "left_semi")
        buckets = bucket_count(ids.count())
        name = self._write(ids.select("event_id"), buckets)
        fresh.write.parquet(f"{self.root}/{name}-attempts")
        generations = generations | {name: buckets}
        if len(generations) > MAX_GENERATIONS:
            generations = self._merged(generations)
        return put_if_absent(self.spark, f"{self.versions}/{number + 1:012d}", json.dumps(generations))

    def _merged(self, generations: dict[str, int]) -> dict[str, int]:
        together = None
        for name, buckets in generations.items():
            part = self._generation(name, buckets)
            together = part if together is None else together.unionByName(part)
        buckets = bucket_count(together.count())
        merged = self._write(together, buckets)
        paths = [f"{self.root}/{name}-attempts" for name in generations]
        self.spark.read.parquet(*paths).write.parquet(f"{self.root}/{merged}-attempts")
        return {merged: buckets}

    def drop_unused(self) -> list[str]:
        """Remove generations and markers that the current version doesn't use; what went."""
        number, generations = self._version()
        fs, p = _fs(self.spark, self.root)
        used = {*generations, *(f"{g}-attempts" for g in generations), "_versions"}
        gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in used]
        fs, p = _fs(self.spark, self.versions)
        gone += [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() != f"{number:012d}"]
        for path in gone:
            fs.delete(path, True)
        return [path.getName() for path in gone]

    def among(self, ids: DataFrame, fresh: DataFrame, bronze: DataFrame, few: list[str] | None = None) -> DataFrame:
        """The distinct ids of ``ids`` that history holds.

        ``fresh`` has the attempts that aren't indexed; as attempts are partitions of
        ``bronze``, theirs are the only ones read. ``few`` gives the ids as literals as
        well if they are at most ``FEW``.
        """
        parts = [bronze.join(fresh, list(ATTEMPT_KEY), "left_semi").select("event_id")]
        parts += [self._generation(name, n) for name, n in self._version()[1].items()]
        wanted = ids.select("event_id")
        found = None
        for part in parts:
            hit = part.where(F.col("event_id").isin(few)) if few is not None else part.join(wanted, "event_id", "left_semi")
            found = hit if found is None else found.unionByName(hit)
        return found.distinct()
