"""Durable warehouse on a shared filesystem.

Layout under ``root`` (any Hadoop-compatible URI)::

    commits/<number>                        the batch and attempt that the number committed
    receipts/batch_id=<id>/attempt_id=<a>/    one row per attempt
    bronze/batch_id=<id>/attempt_id=<a>/      accepted events of one attempt at that batch
    quarantine/batch_id=<id>/attempt_id=<a>/  rejected lines of that attempt
    event_ids/                              bucketed index of committed event ids (``plans.ids``)
    silver/v=<version>/event_date=<d>/  silver, the dates that the version wrote
    gold/v=<version>/<table>/   the six gold tables; sessions by start date like silver
    gold/_committed/<version>   marker: the version is complete. Its manifest has the
                                commits that it covers and the version of each date's files

Exactly-once without transactions: every attempt at a batch writes to folders of
its own and is committed by taking the next number of the commit
log (``plans.commits``), which one writer alone can do. Readers join bronze,
quarantine and receipts to the log on batch and attempt (``left_semi``), so what
a failed attempt left is never seen, whatever the session's overwrite mode. A
writer that finds its number taken looks for its batch and for duplicates again,
so several writers keep one receipt per batch and one event per id. A rebuild
writes a new version and publishes it by creating its marker; a failed rebuild
leaves the previous version current. ``snapshot`` pins the log and the version
for reads that must agree while others commit.
"""

from __future__ import annotations

import copy
import datetime as dt
import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from lumenfold import __version__
from lumenfold.functions.timeutil import utc_date
from lumenfold.operators import metrics as M
from lumenfold.operators.anomalies import anomalies
from lumenfold.operators.audit import constraint_audit
from lumenfold.operators.cohorts import CohortReview, cohort_review
from lumenfold.operators.daily import daily_metrics
from lumenfold.operators.funnel import funnel
from lumenfold.operators.ingest import bronze_rows, materialize, quarantine_rows, receipt_counts, route, stage_validated
from lumenfold.operators.ordering import bucket_plan
from lumenfold.operators.players import player_summary
from lumenfold.operators.retention import retention
from lumenfold.operators.sessions import sessions
from lumenfold.operators.silver import silver
from lumenfold.plans.commits import CommitLog, put_if_absent, read_text
from lumenfold.plans.ids import FEW, EventIds
from lumenfold.schema import (
    AMOUNT_RANGE,
    BATCH_ID_STRICT_PATTERN,
    BRONZE,
    CURRENCY_PATTERN,
    EVENT_ID_PATTERN,
    EVENT_TYPES,
    GAME_VERSION_PATTERN,
    GOLD_TABLES,
    LEVEL_RANGE,
    MAX_BATCH_ID_CHARS,
    PLATFORMS,
    PLAYER_ID_PATTERN,
    QUARANTINE,
    REASON_CODES,
    RECEIPTS,
    SILVER_COLUMNS,
)
from lumenfold.session import checkpoint_dir, ensure_utc
from lumenfold.sources.ndjson import file_digests, lines_digest, lines_from_files, located, number_lines, records_to_lines

RECEIPT_LISTING_LIMIT = 100
#: Batches committed since the last index generation before the next one is written.
INDEX_EVERY = 32
#: Partition column of one attempt at a batch.
ATTEMPT = StructField("attempt_id", StringType())
#: Tables kept by date, and the column that names the folder.
DATED = {"silver": "event_date", "gold_sessions": "start_date"}
EXPORT_SCOPE = "current global gold tables; cohort review filters are separate"


class BatchConflictError(ValueError):
    """A batch id was reused for different source bytes."""


class InputRefused(ValueError):
    """Strict-input or admission checks refused the whole input; nothing was written."""


@dataclass(frozen=True)
class IngestionResult:
    batch_id: str
    source_sha256: str
    received: int
    accepted: int
    quarantined: int
    already_processed: bool = False


@dataclass(frozen=True)
class AdmissionLimits:
    """Optional admission limits (A10). ``None`` disables a limit."""

    max_input_bytes: int | None = None
    max_input_rows: int | None = None
    max_warehouse_rows: int | None = None


def check_batch_id(batch_id: str, strict: bool = False) -> str:
    """A5: 1..80 characters; strict mode also restricts the alphabet."""
    if not isinstance(batch_id, str) or not batch_id or len(batch_id) > MAX_BATCH_ID_CHARS:
        raise ValueError(f"batch_id must be a text of 1 to {MAX_BATCH_ID_CHARS} characters")
    if strict and not re.fullmatch(BATCH_ID_STRICT_PATTERN, batch_id):
        raise ValueError("batch_id must start with a letter or digit and use only [A-Za-z0-9_.:-]")
    return batch_id


class Warehouse:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        limits: AdmissionLimits | None = None,
        payload_chars: int | None = None,
        detail_chars: int | None = None,
    ):
        """``payload_chars`` and ``detail_chars`` cut stored raw lines and details of rejected ones (B20:
        ``MAX_RAW_PAYLOAD_CHARS``, ``MAX_DETAIL_CHARS``); both are whole by default."""
        self.spark = ensure_utc(spark)
        self.payload_chars = payload_chars
        self.detail_chars = detail_chars
        self.root = root.rstrip("/")
        self.limits = limits or AdmissionLimits()
        self.receipts_path = f"{self.root}/receipts"
        self.bronze_path = f"{self.root}/bronze"
        self.quarantine_path = f"{self.root}/quarantine"
        self.silver_root = f"{self.root}/silver"
        self.gold_root = f"{self.root}/gold"
        self.markers = f"{self.gold_root}/_committed"
        self.commits = CommitLog(self.spark, f"{self.root}/commits")
        self.event_ids = EventIds(self.spark, f"{self.root}/event_ids")
        self.index_every = INDEX_EVERY
        #: Commit number and version that reads are pinned to.
        self._up_to: int | None = None
        self._pinned_version: str | None = None

    # -- filesystem helpers (Hadoop FS API, works for any cluster store) -----
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def initialize(self) -> Warehouse:
        for path in (self.receipts_path, self.bronze_path, self.quarantine_path, self.silver_root, self.markers):
            fs, p = self._fs(path)
            fs.mkdirs(p)
        self.commits.create()
        self.event_ids.create()
        return self

    def snapshot(self) -> Warehouse:
        """A handle whose reads all see the commits and the version of this moment."""
        pinned = copy.copy(self)
        pinned._up_to = self.commits.last() if self._up_to is None else self._up_to
        pinned._pinned_version = self.current_version()
        return pinned

    # -- durable table scans (A16) -------------------------------------------
    def receipts(self) -> DataFrame:
        return self._committed(self.receipts_path, RECEIPTS)

    def _attempts(self, after: int = 0) -> DataFrame:
        return self.commits.entries(self._up_to).where(F.col("number") > after).select("batch_id", "attempt_id")

    def _every_attempt(self, path: str, schema) -> DataFrame:
        return self.spark.read.schema(StructType([*schema.fields, ATTEMPT])).parquet(path)

    def _committed(self, path: str, schema, after: int = 0) -> DataFrame:
        rows = self._every_attempt(path, schema).join(self._attempts(after), ["batch_id", "attempt_id"], "left_semi")
        return rows.select(*schema.fieldNames())

    def bronze(self, after: int = 0) -> DataFrame:
        """Accepted events; with ``after`` those of later commits than that number."""
        return self._committed(self.bronze_path, BRONZE, after)

    def quarantine(self) -> DataFrame:
        return self._committed(self.quarantine_path, QUARANTINE)

    # -- ingest (A5-A11, B*) --------------------------------------------------
    def _prior(self, batch_id: str, source_sha256: str) -> IngestionResult | None:
        """The receipt of a batch that was committed before; other bytes under its id are refused."""
        found = self.receipts().filter(F.col("batch_id") == batch_id).limit(1).collect()
        if not found:
            return None
        row = found[0]
        if row["source_sha256"] != source_sha256:
            raise BatchConflictError(f"batch {batch_id!r} was committed from other bytes")
        return IngestionResult(
            batch_id, source_sha256, row["received_count"], row["accepted_count"],
            row["quarantine_count"], already_processed=True,
        )

    def ingest_lines(
        self, lines: DataFrame, batch_id: str, source_sha256: str, strict: bool = False
    ) -> IngestionResult:
        """Validate, route and commit one batch of ``(line_number, raw)`` lines."""
        check_batch_id(batch_id, strict)
        number = self.commits.last() + 1
        prior = self._prior(batch_id, source_sha256) if number > 1 else None
        if prior:
            return prior
        lines = lines.select(F.lit(batch_id).alias("batch_id"), "line_number", "raw")
        if self.limits.max_input_rows is not None or self.limits.max_warehouse_rows is not None:
            n = lines.count()
            if self.limits.max_input_rows is not None and n > self.limits.max_input_rows:
                raise InputRefused("input exceeds the line limit")
            if self.limits.max_warehouse_rows is not None:
                held = self.receipts().agg(F.coalesce(F.sum("received_count"), F.lit(0))).first()[0]
                if held + n > self.limits.max_warehouse_rows:
                    raise InputRefused("the warehouse has no room for so many lines; nothing was written")
        staging = f"{checkpoint_dir(self.spark).rstrip('/')}/lumenfold-stage-{uuid.uuid4().hex}"
        try:
            return self._validate_route_commit(lines, batch_id, source_sha256, strict, staging, number)
        finally:
            fs, p = self._fs(staging)
            fs.delete(p, True)  # the batch's staging table is no longer needed

    def _validate_route_commit(
        self, lines: DataFrame, batch_id: str, source_sha256: str, strict: bool, staging: str, number: int
    ) -> IngestionResult:
        checked = stage_validated(lines, f"{staging}/lines", strict_duplicates=strict)
        if strict:
            refused = checked.filter(F.col("strict_refused"))
            if refused.limit(1).count() > 0:
                raise InputRefused("duplicate keys, non-finite numbers or non-object lines are not supported")
            checked = checked.drop("strict_refused")
        while True:
            fresh, behind = self.event_ids.fresh(self._attempts())
            known = self._known(checked, fresh)
            result = self._attempt(lines, checked, known, batch_id, source_sha256, number, staging)
            if result:
                break
            # Another writer took the number: with this batch, or with events that this one may repeat.
            number = self.commits.last() + 1
            prior = self._prior(batch_id, source_sha256)
            if prior:
                return prior
        if behind + 1 >= self.index_every:
            self.index_ids()
        return result

    def _attempt(
        self, lines: DataFrame, checked: DataFrame, known, batch_id: str, source_sha256: str, number: int, staging: str
    ) -> IngestionResult | None:
        """Write one attempt and commit it as ``number``; None if another writer took the number meanwhile."""
        attempt = uuid.uuid4().hex
        # Both staged tables are plain files: nothing below reads the tables that are appended to.
        routed = route(lines, existing_ids=known, checked=checked, staging=f"{staging}/duplicates-{attempt}")
        now = dt.datetime.now(dt.timezone.utc)
        # A folder of the attempt's own: writers that share one would share its temporary files.
        name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(batch_id)
        place = f"batch_id={name}/attempt_id={attempt}"
        bronze_rows(routed, self.payload_chars).drop("batch_id").write.parquet(f"{self.bronze_path}/{place}")
        rejected = quarantine_rows(routed, now, self.payload_chars, self.detail_chars)
        rejected.drop("batch_id").write.parquet(f"{self.quarantine_path}/{place}")
        counts = receipt_counts(routed).first()
        values = (source_sha256, now, now, counts["received_count"], counts["accepted_count"], counts["quarantine_count"])
        receipt = self.spark.createDataFrame([values], StructType([f for f in RECEIPTS.fields if f.name != "batch_id"]))
        receipt.coalesce(1).write.parquet(f"{self.receipts_path}/{place}")
        if not self.commits.add(number, batch_id, attempt):
            return None
        return IngestionResult(
            batch_id, source_sha256, counts["received_count"], counts["accepted_count"], counts["quarantine_count"]
        )

    def _known(self, checked: DataFrame, fresh: DataFrame):
        """For ``route``, which of a batch's ids are committed already."""
        if self.commits.last() == 0:
            return None
        few = None
        if checked.count() <= FEW:  # the row count of a staged file
            few = [r[0] for r in checked.where("reason_code is null").select("event_id").distinct().collect()]
        ids = self._every_attempt(self.bronze_path, BRONZE).select("event_id", "batch_id", "attempt_id")
        return lambda wanted: self.event_ids.among(wanted, fresh, ids, few)

    def index_ids(self) -> bool:
        """Bring the id index up to the log; false if another writer did so meanwhile."""
        ids = self._every_attempt(self.bronze_path, BRONZE).select("event_id", "batch_id", "attempt_id")
        return self.event_ids.extend(self._attempts(), ids)

    def ingest_ndjson(self, path: str, batch_id: str, strict: bool = False) -> IngestionResult:
        """A1/A4: NDJSON file(s); invalid UTF-8 aborts before any write."""
        check_batch_id(batch_id, strict)
        if self.limits.max_input_bytes is not None:
            # Only the length column: the binary source then skips file contents.
            size = self.spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
            if size == 0 or size > self.limits.max_input_bytes:
                raise InputRefused("input must be non-empty and within the byte limit")
        return self.ingest_text(located(self.spark.read.text(path)), batch_id, strict)

    def ingest_text(self, scanned: DataFrame, batch_id: str, strict: bool = False) -> IngestionResult:
        """A text scan with its places (``sources.ndjson.located``), as files and micro-batches give it."""
        check_batch_id(batch_id, strict)
        lines, bad = number_lines(scanned, batch_id)
        staging = f"{checkpoint_dir(self.spark).rstrip('/')}/lumenfold-lines-{uuid.uuid4().hex}"
        try:
            if not bad.isEmpty():
                raise UnicodeDecodeError("utf-8", b"", 0, 1, "source is not valid UTF-8")
            lines = materialize(lines, staging)  # digest, limits and validation read it
            return self.ingest_lines(lines, batch_id, lines_digest(lines).first()["source_sha256"], strict)
        finally:
            fs, p = self._fs(staging)
            fs.delete(p, True)

    def ingest_files(self, files: DataFrame, batch_id: str, strict: bool = False) -> IngestionResult:
        """Ingest ``binaryFile`` rows, whole files of at most 2 GB each, as one batch
        numbered on in path order and keyed by the digest of its lines."""
        lines, bad, checksum = lines_from_files(files, batch_id)
        if bad.limit(1).count() > 0:
            raise UnicodeDecodeError("utf-8", b"", 0, 1, "source is not valid UTF-8")
        digest = checksum.first()["source_sha256"]
        if digest is None:
            raise InputRefused("no input files")
        return self.ingest_lines(lines, batch_id, digest, strict)

    def ingest_records(self, records: DataFrame, batch_id: str, order_by: list[str]) -> IngestionResult:
        """A3: records serialised canonically (sorted keys), numbered by ``order_by``."""
        check_batch_id(batch_id)
        staging = f"{checkpoint_dir(self.spark).rstrip('/')}/lumenfold-lines-{uuid.uuid4().hex}"
        try:
            # Numbering reads its input twice (counts, then offsets); stage it once.
            lines = materialize(records_to_lines(records, order_by, batch_id), staging)
            return self.ingest_lines(lines, batch_id, lines_digest(lines).first()["source_sha256"])
        finally:
            fs, p = self._fs(staging)
            fs.delete(p, True)

    def receipt_listing(self) -> DataFrame:
        """Receipts ordered by id, first 100."""
        return (
            self.receipts()
            .select("batch_id", "source_sha256", "received_count", "accepted_count", "quarantine_count")
            .orderBy("batch_id")
            .limit(RECEIPT_LISTING_LIMIT)
        )

    # -- rebuild (G1-G3) --------------------------------------------------------
    def _versions(self) -> list[str]:
        fs, p = self._fs(self.markers)
        if not fs.exists(p):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(p))
        return sorted(n for n in names if not n.startswith(("_", ".")))

    def manifest(self, version: str) -> dict:
        """``commits`` that the version covers; ``dates``: per dated table the version that holds each date."""
        return json.loads(read_text(self.spark, f"{self.markers}/{version}"))

    def current_version(self) -> str | None:
        if self._up_to is not None:
            return self._pinned_version
        versions = self._versions()
        return versions[-1] if versions else None

    @staticmethod
    def new_version() -> str:
        return dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%fZ") + "-" + uuid.uuid4().hex[:8]

    def rebuild(self) -> str:
        """Recompute silver and gold from committed bronze into a new version and
        publish it atomically. Silver and sessions are written once and read
        back (lineage cut at a durable table), the rest derive from them."""
        version, pinned = self.new_version(), self.snapshot()
        bronze = pinned.bronze()
        buckets = bucket_plan(bronze)
        self.write_silver(silver(bronze, buckets), version)
        dates = {"silver": self.linked("silver", {}, None, version)}
        s = self.read_dated("silver", dates["silver"])
        self.write_sessions(sessions(s, bucket_seconds=buckets), version)
        dates["gold_sessions"] = self.linked("gold_sessions", {}, None, version)
        sess = self.read_dated("gold_sessions", dates["gold_sessions"])
        self.write_gold(
            {
                "gold_daily_metrics": daily_metrics(s, sess),
                "gold_retention": retention(s),
                "gold_funnel": funnel(s),
                "gold_player_summary": player_summary(s, sess),
                "gold_anomaly_candidates": anomalies(s),
            },
            version,
        )
        return self.publish(version, pinned, dates)

    def refresh(self) -> str:
        """Publish what ``rebuild`` would, rewriting only what batches since the current version change."""
        from lumenfold.plans.refresh import refresh

        return refresh(self)

    # A version in the making: its tables, then its marker.
    def write_silver(self, rows: DataFrame, version: str) -> None:
        """A folder per event_date, so that date filters prune files; the rebalance keeps
        them of even size (AQE joins small and splits large dates). Sorting by player
        clusters row-group statistics, so player filters skip row groups."""
        spread = rows.hint("rebalance", "event_date")
        ordered = spread.sortWithinPartitions("event_date", "player_id", "event_time", "event_id")
        ordered.write.mode("overwrite").partitionBy("event_date").parquet(self._dated_root("silver", version))

    def write_sessions(self, rows: DataFrame, version: str) -> None:
        dated = rows.withColumn(DATED["gold_sessions"], utc_date("session_started_at"))
        spread = dated.hint("rebalance", DATED["gold_sessions"])
        spread.write.mode("overwrite").partitionBy(DATED["gold_sessions"]).parquet(self._dated_root("gold_sessions", version))

    def write_gold(self, tables: dict[str, DataFrame], version: str) -> None:
        """Independent tables: their jobs are submitted together, so small stages do not
        leave executors idle; any failure propagates and no marker is made."""
        with ThreadPoolExecutor(max_workers=len(tables)) as pool:
            futures = [
                pool.submit(lambda n=name, d=df: d.write.mode("overwrite").parquet(f"{self.gold_root}/v={version}/{n}"))
                for name, df in tables.items()
            ]
            for future in futures:
                future.result()

    def publish(self, version: str, pinned: Warehouse, dates: dict[str, dict[str, str]]) -> str:
        content = json.dumps({"commits": pinned._up_to, "dates": dates})
        if not put_if_absent(self.spark, f"{self.markers}/{version}", content):
            raise RuntimeError(f"version {version} exists")
        return version

    # -- tables by date ---------------------------------------------------------
    def _dated_root(self, table: str, version: str) -> str:
        return f"{self.silver_root}/v={version}" if table == "silver" else f"{self.gold_root}/v={version}/{table}"

    def _dates_in(self, table: str, version: str) -> list[str]:
        """The dates that a version wrote itself."""
        fs, p = self._fs(self._dated_root(table, version))
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        mark = f"{DATED[table]}="
        return [n.removeprefix(mark) for n in names if n.startswith(mark)]

    def linked(self, table: str, before: dict[str, str], rewritten: list[dt.date] | None, version: str) -> dict[str, str]:
        """Which version holds each date: ``version`` those that it wrote, else as before; rewritten ones may be gone."""
        gone = {str(d) for d in rewritten or ()}
        kept = {d: v for d, v in before.items() if d not in gone}
        return kept | {d: version for d in self._dates_in(table, version)}

    def read_dated(self, table: str, dates: dict[str, str]) -> DataFrame:
        # With its schema, as a table without rows has no date folders to tell it from.
        rows = silver(self.bronze())
        schema, columns = rows.schema, SILVER_COLUMNS
        if table == "gold_sessions":
            rows = sessions(rows)
            columns = rows.columns
            schema = StructType([*rows.schema.fields, StructField(DATED[table], DateType())])
        found = None
        for version in sorted(set(dates.values())):
            root, own = self._dated_root(table, version), [d for d, v in dates.items() if v == version]
            whole = set(own) == set(self._dates_in(table, version))
            paths = [root] if whole else [f"{root}/{DATED[table]}={d}" for d in own]
            part = self.spark.read.schema(schema).option("basePath", root).parquet(*paths)
            found = part if found is None else found.unionByName(part)
        return (self.spark.createDataFrame([], schema) if found is None else found).select(*columns)

    def silver(self) -> DataFrame:
        return self.read_dated("silver", self.manifest(self._require_version())["dates"]["silver"])

    def drop_versions(self, keep: int = 2) -> list[str]:
        """Remove all but the newest ``keep`` rebuilt versions, marker first; their names."""
        if keep < 1:
            raise ValueError("at least the current version must be kept")
        versions = self._versions()
        old, kept = versions[:-keep], versions[-keep:]
        used = {(t, v, d) for k in kept for t, dates in self.manifest(k)["dates"].items() for d, v in dates.items()}
        for version in old:
            gone = [f"{self.markers}/{version}"]
            linked = {t: [d for d in self._dates_in(t, version) if (t, version, d) in used] for t in DATED}
            for table, root in (("silver", self.silver_root), ("gold_sessions", self.gold_root)):
                if not linked[table]:
                    gone.append(f"{root}/v={version}")
                    continue
                # Dates that a kept version links stay.
                here = self._dated_root(table, version)
                gone += [f"{here}/{DATED[table]}={d}" for d in self._dates_in(table, version) if d not in linked[table]]
                if table != "silver":
                    gone += [f"{root}/v={version}/{t}" for t in GOLD_TABLES if t != table]
            for path in gone:
                fs, p = self._fs(path)
                fs.delete(p, True)
        return old

    def gold(self, table: str) -> DataFrame:
        if table not in GOLD_TABLES:
            raise ValueError(f"unknown gold table: {table}")
        version = self._require_version()
        if table in DATED:
            return self.read_dated(table, self.manifest(version)["dates"][table])
        return self.spark.read.parquet(f"{self.gold_root}/v={version}/{table}")

    def _require_version(self) -> str:
        version = self.current_version()
        if version is None:
            raise RuntimeError("no committed rebuild; call rebuild() first")
        return version

    def tables(self) -> dict[str, DataFrame]:
        out = {name: self.gold(name) for name in GOLD_TABLES}
        out.update(silver_events=self.silver(), bronze=self.bronze(), quarantine=self.quarantine())
        return out

    # -- reads --------------------------------------------------------------------
    def metric(self, name: str, limit: int = M.PLAYERS_DEFAULT, player_id: str = "") -> DataFrame:
        return M.metric(self.tables(), name, limit, player_id)

    def health(self) -> DataFrame:
        return M.health(self.bronze(), self.receipts())

    def cohort(self, **filters) -> CohortReview:
        return cohort_review(self.silver(), **filters)

    def audit(self) -> DataFrame:
        """A18 over the warehouse tables, with the generated UTC date of silver once it is built."""
        bronze = self.bronze()
        receipts = self.receipts()
        b = constraint_audit(
            bronze,
            "bronze_events",
            primary_key=["event_id"],
            not_null=[f.name for f in BRONZE.fields if not f.nullable],
            checks={
                "check:schema_version=1": F.col("schema_version") == 1,
                "check:received_at>=event_time": F.col("received_at") >= F.col("event_time"),
                "check:event_id": F.col("event_id").rlike(EVENT_ID_PATTERN),
                "check:player_id": F.col("player_id").rlike(PLAYER_ID_PATTERN),
                "check:game_version": F.col("game_version").rlike(GAME_VERSION_PATTERN),
                "check:currency": F.col("currency").rlike(CURRENCY_PATTERN),
                "check:event_type": F.col("event_type").isin(*EVENT_TYPES),
                "check:platform": F.col("platform").isin(*PLATFORMS),
                "check:level": F.col("level").between(*LEVEL_RANGE),
                "check:amount_cents": F.col("amount_cents").between(*AMOUNT_RANGE),
            },
            foreign_keys=[(["batch_id"], receipts, ["batch_id"], "foreign_key:batch_id->receipts")],
        )
        r = constraint_audit(
            receipts,
            "ingestion_batches",
            primary_key=["batch_id"],
            not_null=RECEIPTS.fieldNames(),
            checks={
                "check:counts_non_negative": (F.col("received_count") >= 0)
                & (F.col("accepted_count") >= 0)
                & (F.col("quarantine_count") >= 0),
                "check:received=accepted+quarantined": F.col("received_count")
                == F.col("accepted_count") + F.col("quarantine_count"),
            },
        )
        q = constraint_audit(
            self.quarantine(),
            "quarantine_events",
            primary_key=["quarantine_id"],
            not_null=QUARANTINE.fieldNames(),
            checks={
                "check:line_number>0": F.col("line_number") > 0,
                "check:reason_code": F.col("reason_code").isin(*REASON_CODES),
            },
            foreign_keys=[(["batch_id"], receipts, ["batch_id"], "foreign_key:batch_id->receipts")],
        )
        found = b.unionByName(r).unionByName(q)
        if self.current_version() is None:
            return found
        dated = constraint_audit(
            self.silver(),
            "silver_events",
            primary_key=["event_id"],
            not_null=["player_id", "event_time", "event_sequence"],
            generated={"event_date": utc_date("event_time")},
        )
        return found.unionByName(dated)

    # -- export (A12, A14, A15) -------------------------------------------------
    def export(self, out_dir: str, max_bytes: int | None = None) -> DataFrame:
        """Write each gold table as zstd Parquet under ``out_dir/<table>.parquet`` and
        a manifest: a row per part file (name, bytes, tree digest) in
        ``_manifest/files``, and the summary and scope, which is returned, in
        ``_manifest/summary``. One directory of part files per table."""
        out_dir = out_dir.rstrip("/")
        for name in GOLD_TABLES:
            (
                self.gold(name)
                .write.mode("overwrite")
                .option("compression", "zstd")
                .parquet(f"{out_dir}/{name}.parquet")
            )
        files = export_files(self.spark, out_dir)
        if max_bytes is not None:
            total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
            if total > max_bytes:
                raise ValueError("export exceeds the byte budget")
        files.write.mode("overwrite").json(f"{out_dir}/_manifest/files")
        manifest = M.summary(self.bronze(), self.quarantine()).select(
            F.lit(__version__).alias("application_version"),
            F.current_timestamp().alias("captured_at"),
            F.lit(EXPORT_SCOPE).alias("scope"),
            F.struct("*").alias("summary"),
        )
        manifest.coalesce(1).write.mode("overwrite").json(f"{out_dir}/_manifest/summary")
        return self.spark.read.json(f"{out_dir}/_manifest/summary")


def export_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """(name, bytes, tree_sha256) of each exported part file as it is on disk."""
    return file_digests(spark, f"{out_dir}/*.parquet/*.parquet").select(
        F.regexp_extract("path", r"([^/]+\.parquet/[^/]+)$", 1).alias("name"),
        F.col("length").alias("bytes"),
        "tree_sha256",
    )


def verify_export(spark: SparkSession, out_dir: str) -> dict:
    """Every manifest digest matches the bytes on disk; players = rows of
    the player summary; events = sum(events) of the daily table."""
    out_dir = out_dir.rstrip("/")
    summary = spark.read.json(f"{out_dir}/_manifest/summary").select("summary.*").first()
    listed = spark.read.schema("name string, bytes bigint, tree_sha256 string").json(f"{out_dir}/_manifest/files")
    actual = export_files(spark, out_dir).withColumn("on_disk", F.lit(True))
    both = listed.withColumn("listed", F.lit(True)).join(actual, ["name", "bytes", "tree_sha256"], "full_outer")
    mismatched = both.where("listed is null or on_disk is null")
    if mismatched.limit(1).count() > 0:
        raise ValueError("export checksum mismatch")
    players = spark.read.parquet(f"{out_dir}/gold_player_summary.parquet").count()
    events = spark.read.parquet(f"{out_dir}/gold_daily_metrics.parquet").agg(F.sum("events")).first()[0] or 0
    if players != summary["players"] or events != summary["accepted_events"]:
        raise ValueError("exported counts do not reconcile with the manifest summary")
    files = listed.count()
    return {"players": players, "accepted_events": events, "parquet_files": files, "checksums": "verified"}
