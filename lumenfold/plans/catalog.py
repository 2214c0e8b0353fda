"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver tables (or data Spark derives from them) in
full; nothing is capped, sampled or filtered to a subset. Timestamps are
rendered as naive UTC at the edge (``naive_utc``).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import concat_skip_nulls
from lumenfold.functions.timeutil import naive_utc
from lumenfold.operators import metrics as M
from lumenfold.operators.anomalies import anomalies
from lumenfold.operators.cohorts import cohort_review
from lumenfold.operators.daily import daily_metrics
from lumenfold.operators.funnel import funnel
from lumenfold.operators.ordering import bucket_plan
from lumenfold.operators.players import player_summary
from lumenfold.operators.retention import retention
from lumenfold.operators.sessions import sessions
from lumenfold.operators.silver import silver, silver_columns
from lumenfold.operators.validate import validate
from lumenfold.plans.warehouse import AdmissionLimits, BatchConflictError, InputRefused, Warehouse, verify_export
from lumenfold.session import checkpoint_dir, ensure_checkpoint_dir, ensure_utc
from lumenfold.functions.hashing import check_secret, pseudonymize, pseudonymizer
from lumenfold.operators.audit import constraint_audit, constraint_violations
from lumenfold.operators.privacy import scan_text
from lumenfold.sources.tables import read_table, spread
from lumenfold.operators.ingest import bronze_rows, materialize, quarantine_rows, reason_summary, receipt_counts, route, stage_validated
from lumenfold.schema import GOLD_TABLES
from lumenfold.sources.adapters import RAW_BATCH_ID, RULE_CASES, contract_columns, load_bronze, load_raw_lines, rule_lines
from lumenfold.sources.ndjson import lines_digest, read_ndjson, records_to_lines, write_ndjson
from lumenfold.sources.tables import EVENTS_COLUMNS

Query = Callable[[SparkSession, str], DataFrame]


def _silver_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_columns(load_bronze(ensure_utc(spark), sf_dir))


def _sessions(s: DataFrame) -> DataFrame:
    """Sessions by buckets that fit the fullest player (one small job measures them)."""
    ensure_checkpoint_dir(s.sparkSession)
    return sessions(s, bucket_seconds=bucket_plan(s))


def q_silver(spark, sf_dir):
    bronze = load_bronze(ensure_utc(spark), sf_dir)
    ensure_checkpoint_dir(spark)
    return naive_utc(silver(bronze, bucket_plan(bronze)))


def q_sessions(spark, sf_dir):
    return naive_utc(_sessions(_silver_cols(spark, sf_dir)))


def q_daily_metrics(spark, sf_dir):
    s = _silver_cols(spark, sf_dir)
    return daily_metrics(s, _sessions(s))


def q_retention(spark, sf_dir):
    return retention(_silver_cols(spark, sf_dir))


def q_funnel(spark, sf_dir):
    return funnel(_silver_cols(spark, sf_dir))


def q_player_summary(spark, sf_dir):
    s = _silver_cols(spark, sf_dir)
    return player_summary(s, _sessions(s))


def q_player_summary_churn1(spark, sf_dir):
    s = _silver_cols(spark, sf_dir)
    return player_summary(s, _sessions(s), churn_days=1)


def q_anomalies(spark, sf_dir):
    return naive_utc(anomalies(_silver_cols(spark, sf_dir)))


def q_anomalies_hourly_burst(spark, sf_dir):
    return naive_utc(anomalies(_silver_cols(spark, sf_dir), burst_unit="hour", burst_over=2))


def q_funnel_overall(spark, sf_dir):
    return M.funnel_overall(funnel(_silver_cols(spark, sf_dir)))


def q_newest_anomalies(spark, sf_dir):
    return naive_utc(M.newest_anomalies(anomalies(_silver_cols(spark, sf_dir))))


def q_latest_day(spark, sf_dir):
    s = _silver_cols(spark, sf_dir)
    return M.latest_day(daily_metrics(s, _sessions(s)))


def q_players_top(spark, sf_dir):
    s = _silver_cols(spark, sf_dir)
    return M.players(player_summary(s, _sessions(s)))


def q_retention_rows(spark, sf_dir):
    return M.retention_rows(retention(_silver_cols(spark, sf_dir)))


def q_latest_cohort_retention(spark, sf_dir):
    return M.latest_cohort_retention(retention(_silver_cols(spark, sf_dir)))


def q_timeline_busiest_player(spark, sf_dir):
    s = _silver_cols(spark, sf_dir)
    return naive_utc(M.timeline(s, M.busiest_player(s)))


COHORT_AS_OF = dt.date(2024, 1, 5)


def q_cohort_retention(spark, sf_dir):
    return cohort_review(_silver_cols(spark, sf_dir), platform="pc", as_of=COHORT_AS_OF).retention


def q_cohort_totals(spark, sf_dir):
    return cohort_review(_silver_cols(spark, sf_dir), platform="pc", as_of=COHORT_AS_OF).totals


def q_cohort_retention_watermark(spark, sf_dir):
    return cohort_review(_silver_cols(spark, sf_dir)).retention


def q_cohort_totals_watermark(spark, sf_dir):
    return cohort_review(_silver_cols(spark, sf_dir)).totals


COHORT_FILTERS = {"start": dt.date(2024, 1, 2), "end": dt.date(2024, 1, 3), "version": "1.4.0", "as_of": dt.date(2024, 1, 9)}


def q_cohort_retention_filtered(spark, sf_dir):
    return cohort_review(_silver_cols(spark, sf_dir), **COHORT_FILTERS).retention


def q_cohort_totals_filtered(spark, sf_dir):
    return cohort_review(_silver_cols(spark, sf_dir), **COHORT_FILTERS).totals


def _routed(spark, sf_dir, finish):
    """``finish`` of the routed raw lines, on its own; the staged batch is removed."""
    staging = _scratch(ensure_utc(spark), "stage")
    lines = load_raw_lines(spark, sf_dir)
    checked = stage_validated(lines, staging)
    return _keep_result(spark, finish(route(lines, checked=checked)), staging)


def q_ingest_quarantine(spark, sf_dir):
    columns = ("quarantine_id", "batch_id", "line_number", "reason_code", "details")
    return _routed(spark, sf_dir, lambda routed: quarantine_rows(routed).select(*columns))


def q_ingest_receipt(spark, sf_dir):
    batch = F.lit(RAW_BATCH_ID).alias("batch_id")
    return _routed(spark, sf_dir, lambda routed: receipt_counts(routed).select(batch, "*"))


def q_quarantine_reasons(spark, sf_dir):
    return _routed(spark, sf_dir, lambda routed: reason_summary(quarantine_rows(routed)))


def q_ingest_bronze(spark, sf_dir):
    return naive_utc(_routed(spark, sf_dir, lambda routed: bronze_rows(routed).drop("raw_payload")))


def q_summary(spark, sf_dir):
    return _routed(spark, sf_dir, lambda routed: M.summary(bronze_rows(routed), quarantine_rows(routed)))


PSEUDONYM_SECRET = "lumenfold-example-secret-2024"


def _scratch(spark, name):
    ensure_checkpoint_dir(spark)
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _keep_result(spark, result, path):
    """The (small) result on its own, with the folder it was read from removed."""
    result = result.checkpoint(eager=True)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return result


def q_ndjson_lines(spark, sf_dir):
    """A1, A2: the raw lines written as NDJSON files in order and read back with their numbers."""
    path = _scratch(ensure_utc(spark), "ndjson")
    load_raw_lines(spark, sf_dir).orderBy("line_number").select("raw").write.text(path)
    lines, _ = read_ndjson(spark, path, "files")
    raw = F.col("raw")
    digits = F.regexp_extract(raw, r"(?:broken |^\[)(\d+)", 1)
    hex_id = F.regexp_extract(raw, r"(?i)evt_([0-9a-f]{16})", 1)
    source = F.when(digits != "", digits).otherwise(F.conv(hex_id, 16, 10)).cast("bigint")
    return _keep_result(spark, lines.select("line_number", source.alias("source_id")), path)


def q_ndjson_records(spark, sf_dir):
    """All events as records; their lines, and the files that the NDJSON sink writes, read back.

    A row of line count, lines with a null reason, and whether both checksums agree.
    """
    path = _scratch(ensure_utc(spark), "records")
    records = contract_columns(read_table(spark, sf_dir, "events", EVENTS_COLUMNS))
    write_ndjson(records.orderBy("event_id"), path)
    files, _ = read_ndjson(spark, path, "records")
    digests = lines_digest(files).union(lines_digest(records_to_lines(records, ["event_id"], "records")))
    same = digests.agg((F.count_distinct("source_sha256") == 1).alias("same_checksum"))
    counted = files.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("raw").contains('"reason":null')).alias("null_reasons")
    )
    return _keep_result(spark, counted.crossJoin(F.broadcast(same)), path)


def _two_batches(spark, root, sf_dir):
    """A warehouse with two overlapping batches of the raw lines."""
    warehouse = Warehouse(spark, root).initialize()
    lines = load_raw_lines(spark, sf_dir)
    source = F.shiftright(F.col("line_number") - 1, 1)
    first, second = source % 3 != 0, (source % 3 == 0) | (source % 5 == 0)
    for name, part in (("first", first), ("second", second)):
        warehouse.ingest_lines(lines.where(part), name, name)
    return warehouse


def q_warehouse_daily(spark, sf_dir):
    """Daily metrics of a warehouse that was rebuilt after two batches."""
    root = _scratch(ensure_utc(spark), "warehouse")
    warehouse = _two_batches(spark, root, sf_dir)
    warehouse.rebuild()
    return _keep_result(spark, warehouse.gold("gold_daily_metrics"), root)


def q_warehouse_refresh(spark, sf_dir):
    """G1: the sessions of a warehouse into which a second batch was brought by ``refresh``."""
    root = _scratch(ensure_utc(spark), "warehouse")
    warehouse = Warehouse(spark, root).initialize()
    lines = load_raw_lines(spark, sf_dir)
    second = F.shiftright(F.col("line_number") - 1, 1) % 40 == 7
    warehouse.ingest_lines(lines.where(~second), "first", "first")
    warehouse.rebuild()
    warehouse.ingest_lines(lines.where(second), "second", "second")
    warehouse.refresh()
    return _keep_result(spark, naive_utc(warehouse.gold("gold_sessions")), root)


def q_warehouse_timeline(spark, sf_dir):
    """the busiest player's timeline, by its identifier, from a rebuilt warehouse."""
    root = _scratch(ensure_utc(spark), "warehouse")
    warehouse = _two_batches(spark, root, sf_dir)
    warehouse.rebuild()
    player = M.busiest_player(warehouse.silver()).first().player_id
    return _keep_result(spark, naive_utc(warehouse.metric("timeline", limit=100, player_id=player)), root)


def q_warehouse_export(spark, sf_dir):
    """Figures of a warehouse that was rebuilt, exported, and read back."""
    root = _scratch(ensure_utc(spark), "warehouse")
    warehouse = _two_batches(spark, root, sf_dir)
    warehouse.rebuild()
    manifest = warehouse.export(f"{root}/export")
    verified = verify_export(spark, f"{root}/export")

    def figures(df, label, *columns):
        pairs = F.array(*(F.struct(F.lit(f"{label}:{c}").alias("item"), F.col(c).cast("bigint").alias("value")) for c in columns))
        return df.select(F.inline(pairs))

    parts = [
        figures(warehouse.gold(t).agg(F.count(F.lit(1)).alias(t)), "rows", t) for t in GOLD_TABLES
    ] + [
        figures(manifest.select("summary.*"), "summary", "accepted_events", "players", "late_events", "purchases", "quarantined_events"),
        figures(warehouse.health(), "health", "accepted_events"),
        figures(spark.range(1).select(*(F.lit(verified[k]).alias(k) for k in ("players", "accepted_events"))), "verified", "players", "accepted_events"),
        figures(warehouse.receipt_listing().agg(F.count(F.lit(1)).alias("batches"), F.sum("received_count").alias("received")), "receipts", "batches", "received"),
        figures(warehouse.audit().agg(F.sum("violations").alias("violations")), "audit", "violations"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return _keep_result(spark, result, root)


def q_warehouse_two_batches(spark, sf_dir):
    """Two overlapping batches of the raw lines in one warehouse; rows by outcome."""
    root = _scratch(ensure_utc(spark), "warehouse")
    warehouse = _two_batches(spark, root, sf_dir)
    accepted = warehouse.bronze().groupBy("batch_id").agg(F.count("*").alias("rows"))
    result = accepted.select("batch_id", F.lit("accepted").alias("outcome"), "rows").union(
        reason_summary(warehouse.quarantine())
    )
    counts = warehouse.receipts().select(
        "batch_id", F.explode(F.create_map(
            F.lit("receipt:received"), F.col("received_count"),
            F.lit("receipt:accepted"), F.col("accepted_count"),
            F.lit("receipt:quarantined"), F.col("quarantine_count"),
        )).alias("outcome", "rows"),
    )
    return _keep_result(spark, result.union(counts), root)


def q_warehouse_replay(spark, sf_dir):
    """A batch replayed, its id used for other bytes, and an overlapping batch over indexed ids.

    One row per step: what came of it, the counts of its receipt, and the receipts of the warehouse after it.
    """
    root = _scratch(ensure_utc(spark), "warehouse")
    warehouse = Warehouse(spark, root).initialize()
    lines = load_raw_lines(spark, sf_dir)
    source = F.shiftright(F.col("line_number") - 1, 1)
    steps = []
    for step, part, batch_id, checksum in (
        ("first", source % 3 != 0, "one", "a"),
        ("replay", source % 3 != 0, "one", "a"),
        ("conflict", source % 3 == 0, "one", "b"),
        ("overlap", source % 2 == 0, "two", "c"),
        ("again", source % 2 == 0, "three", "c"),
    ):
        try:
            result = warehouse.ingest_lines(lines.where(part), batch_id, checksum)
            outcome = "replayed" if result.already_processed else "committed"
            counts = (result.received, result.accepted, result.quarantined)
        except BatchConflictError:
            outcome, counts = "refused", (None, None, None)
        if step == "conflict":
            warehouse.index_ids()
        steps.append((step, outcome, *counts, warehouse.receipts().count()))
    schema = "step string, outcome string, received bigint, accepted bigint, quarantined bigint, receipts bigint"
    return _keep_result(spark, spark.createDataFrame(steps, schema), root)


def q_warehouse_snapshot(spark, sf_dir):
    """A snapshot's reads while a second batch is committed and a second version published.

    Daily events of the snapshot and of the warehouse after it, and the cohort review's totals of each as of a day.
    """
    root = _scratch(ensure_utc(spark), "warehouse")
    warehouse = Warehouse(spark, root).initialize()
    lines = load_raw_lines(spark, sf_dir)
    source = F.shiftright(F.col("line_number") - 1, 1)
    warehouse.ingest_lines(lines.where(source % 3 != 0), "first", "first")
    warehouse.rebuild()
    before = warehouse.snapshot()
    warehouse.ingest_lines(lines.where(source % 3 == 0), "second", "second")
    warehouse.rebuild()
    result = None
    for name, handle in (("before", before), ("after", warehouse)):
        review = handle.cohort(as_of=COHORT_AS_OF)
        rows = (
            handle.gold("gold_daily_metrics").select(F.col("event_date").cast("string").alias("item"), F.col("events").alias("value")),
            handle.bronze().agg(F.lit("bronze").alias("item"), F.count("*").alias("value")),
            handle.receipts().agg(F.lit("receipts").alias("item"), F.count("*").alias("value")),
            review.totals.select(F.lit("cohort_players").alias("item"), F.col("cohort_players").alias("value")),
        )
        for part in rows:
            part = part.select(F.lit(name).alias("handle"), "item", F.col("value").cast("bigint").alias("value"))
            result = part if result is None else result.unionByName(part)
    return _keep_result(spark, result, root)


def q_warehouse_refusals(spark, sf_dir):
    """What must be refused is, and leaves the warehouse as it was.

    All raw lines are offered each time; a row per offer with its outcome and the
    warehouse's receipts and accepted events after it.
    """
    root = _scratch(ensure_utc(spark), "warehouse")
    lines = materialize(load_raw_lines(spark, sf_dir), f"{root}/lines")
    n = lines.count()

    def warehouse(**limits):
        return Warehouse(spark, f"{root}/wh", limits=AdmissionLimits(**limits)).initialize()

    plain = warehouse()
    offers = [
        ("A10:rows above the limit", lambda: warehouse(max_input_rows=n - 1).ingest_lines(lines, "all", "x")),
        ("A10:rows at the limit", lambda: warehouse(max_input_rows=n).ingest_lines(lines, "all", "x")),
        ("A10:no room in the warehouse", lambda: warehouse(max_warehouse_rows=2 * n - 1).ingest_lines(lines, "more", "y")),
        ("A11:strict input", lambda: plain.ingest_lines(lines, "strict", "z", strict=True)),
        ("A11:strict name", lambda: plain.ingest_lines(lines, "../all", "z", strict=True)),
        ("A5:empty name", lambda: plain.ingest_lines(lines, "", "z")),
        ("A5:name of 81 characters", lambda: plain.ingest_lines(lines, "n" * 81, "z")),
        ("A7:other bytes", lambda: plain.ingest_lines(lines, "all", "y")),
        ("B18:key of 15 characters", lambda: check_secret("k" * 15)),
        ("B18:key of 16 characters", lambda: check_secret("k" * 16)),
        ("K1:end before start", lambda: cohort_review(silver_columns(plain.bronze()), start=COHORT_AS_OF, end=dt.date(2024, 1, 4))),
        ("K1:platform", lambda: cohort_review(silver_columns(plain.bronze()), platform="abacus")),
        ("K1:version", lambda: cohort_review(silver_columns(plain.bronze()), version="one")),
        ("K2:day not known yet", lambda: cohort_review(silver_columns(plain.bronze()), as_of=dt.date(2999, 1, 1))),
    ]
    rows = []
    for case, offer in offers:
        try:
            offer()
            outcome = "taken"
        except (InputRefused, BatchConflictError, ValueError) as error:
            outcome = "refused" if type(error) is ValueError else type(error).__name__
        rows.append((case, outcome, plain.receipts().count(), plain.bronze().count()))
    return _keep_result(spark, spark.createDataFrame(rows, "case string, outcome string, receipts bigint, accepted bigint"), root)


def q_ingest_bounds(spark, sf_dir):
    """Lengths of stored raw lines and details, whole and cut, by reason; how many cut ones begin the whole."""
    def finish(routed):
        whole = quarantine_rows(routed).select("quarantine_id", "reason_code", "raw_payload", "details")
        cut = quarantine_rows(routed, payload_chars=40, detail_chars=10).select(
            "quarantine_id", F.col("raw_payload").alias("cut_payload"), F.col("details").alias("cut_details")
        )
        return whole.join(cut, "quarantine_id").groupBy("reason_code").agg(
            F.count("*").alias("rows"),
            F.max(F.length("cut_payload")).cast("bigint").alias("longest_payload"),
            F.max(F.length("cut_details")).cast("bigint").alias("longest_details"),
            F.sum(F.length("details")).cast("bigint").alias("detail_chars"),
            F.count_if(
                F.expr("startswith(raw_payload, cut_payload) and startswith(details, cut_details)")
                & (F.length("cut_payload") == F.least(F.lit(40), F.length("raw_payload")))
            ).alias("beginnings"),
        )

    return _routed(spark, sf_dir, finish)


def q_cohort_no_data(spark, sf_dir):
    """The review of events of which none is left: header and totals, no retention row."""
    none = _silver_cols(spark, sf_dir).where("event_time < timestamp_ntz'1900-01-01'")
    review = cohort_review(none)
    return review.header.select("as_of", "available_through").crossJoin(review.totals).crossJoin(
        review.retention.agg(F.count("*").alias("retention_rows"))
    )


def q_null_parts(spark, sf_dir):
    """Parts of which some are null, joined as the metric layer does, by event type."""
    text = concat_skip_nulls("event_type", F.lit("-"), "level", F.lit("-"), "amount_cents", "currency", F.lit("-"), "reason")
    return _silver_cols(spark, sf_dir).groupBy(text.alias("label")).agg(F.count("*").alias("events"))


def q_contract_rules(spark, sf_dir):
    """A changed line per event and rule; verdicts, rule codes and levels by case."""
    lines = rule_lines(spread(read_table(ensure_utc(spark), sf_dir, "events", ("event_id",))))
    case = ((F.col("line_number") - 1) % len(RULE_CASES)).cast("int").alias("case_no")
    return (
        validate(lines)
        .groupBy(case, F.coalesce("reason_code", F.lit("accepted")).alias("verdict"), F.coalesce("details", F.lit("")).alias("codes"))
        .agg(F.count("*").alias("rows"), F.max("level").alias("level"))
    )


def q_documents_privacy(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return scan_text(docs, ["doc_id"], "text")


def q_conversations_privacy(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    return scan_text(conv, ["conv_id", "turn"], "text")


def q_conversations_credentials(spark, sf_dir):
    """The scan over all turns, some of which are given a credential, an address or a number by their keys."""
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    place = F.coalesce("conv_id", F.lit(0)) * 31 + F.coalesce("turn", F.lit(0))
    leaks = F.concat(
        F.when(place % 5 == 0, F.lit(" Authorization: BEARER\u00a0abc.DEF-123_456~789+/=")).otherwise(""),
        F.when(place % 7 == 0, F.lit(" mail someone.else+x@mail.example.org now")).otherwise(""),
        F.when(place % 11 == 0, F.lit(" call +1 (555) 010-9999 today")).otherwise(""),
        F.when(place % 13 == 0, F.lit(" bearer short")).otherwise(""),
    )
    texts = conv.withColumn("text", F.concat(F.coalesce("text", F.lit("")), leaks))
    return scan_text(texts, ["conv_id", "turn"], "text")


def q_customer_pseudonyms(spark, sf_dir):
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    pseudonym = pseudonymizer(spark, PSEUDONYM_SECRET)
    return cust.select("c_custkey", pseudonym(F.col("c_name")).alias("player_id"))


def q_customer_pseudonyms_native(spark, sf_dir):
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    return cust.select("c_custkey", pseudonymize(F.col("c_name"), PSEUDONYM_SECRET).alias("player_id"))


def q_orders_audit(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    return constraint_audit(orders, "orders", **_orders_rules(spark, sf_dir))


def _broken_orders(spark, sf_dir):
    """All orders, with rows broken by the remainder of their key."""
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    key = F.col("o_orderkey")
    return orders.select(
        key,
        F.when(key % 97 == 0, None).when(key % 79 == 0, -1 - key).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(key % 83 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 89 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(key % 71 != 0, F.col("o_orderdate")).alias("o_orderdate"),
        F.explode(F.when(key % 101 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _orders_rules(spark, sf_dir):
    customer = read_table(spark, sf_dir, "customer", ["c_custkey"])
    return {
        "primary_key": ["o_orderkey"],
        "not_null": ["o_custkey", "o_orderdate"],
        "checks": {
            "check:o_totalprice>=0": F.col("o_totalprice") >= 0,
            "check:o_orderstatus_enum": F.col("o_orderstatus").isin("O", "F", "P"),
        },
        "foreign_keys": [(["o_custkey"], customer, ["c_custkey"], "foreign_key:o_custkey->customer")],
    }


def q_orders_audit_broken(spark, sf_dir):
    """The audit over all orders with rows broken by the remainder of their key."""
    return constraint_audit(_broken_orders(spark, sf_dir), "orders", **_orders_rules(spark, sf_dir))


def q_orders_violations(spark, sf_dir):
    """The same orders; which keys break each constraint, and a generated year beside the date."""
    year = F.when(F.col("o_orderkey") % 67 == 0, F.lit(1900)).otherwise(F.year("o_orderdate"))
    broken = _broken_orders(spark, sf_dir).withColumn("order_year", year)
    return constraint_violations(
        broken, "orders", ["o_orderkey"], generated={"order_year": F.year("o_orderdate")}, **_orders_rules(spark, sf_dir)
    )


def q_cohort_header(spark, sf_dir):
    return cohort_review(_silver_cols(spark, sf_dir), platform="pc", as_of=COHORT_AS_OF).header


def q_events_audit(spark, sf_dir):
    from pyspark.sql import functions as F

    bronze = load_bronze(ensure_utc(spark), sf_dir)
    return constraint_audit(
        bronze,
        "bronze_events",
        primary_key=["event_id"],
        not_null=["event_id", "player_id", "event_type", "event_time", "received_at"],
        checks={
            "check:schema_version=1": F.col("schema_version") == 1,
            "check:received_at>=event_time": F.col("received_at") >= F.col("event_time"),
            "check:event_type_enum": F.col("event_type").isin(
                "session_start", "level_start", "level_complete", "purchase", "reset"
            ),
            "check:amount_range": F.col("amount_cents").between(0, 100000),
        },
    )


QUERIES: dict[str, Query] = {
    "silver": q_silver,
    "sessions": q_sessions,
    "daily_metrics": q_daily_metrics,
    "retention": q_retention,
    "funnel": q_funnel,
    "player_summary": q_player_summary,
    "player_summary_churn1": q_player_summary_churn1,
    "anomalies": q_anomalies,
    "anomalies_hourly_burst": q_anomalies_hourly_burst,
    "funnel_overall": q_funnel_overall,
    "newest_anomalies": q_newest_anomalies,
    "latest_day": q_latest_day,
    "players_top": q_players_top,
    "retention_rows": q_retention_rows,
    "latest_cohort_retention": q_latest_cohort_retention,
    "timeline_busiest_player": q_timeline_busiest_player,
    "cohort_retention": q_cohort_retention,
    "cohort_totals": q_cohort_totals,
    "cohort_retention_watermark": q_cohort_retention_watermark,
    "cohort_totals_watermark": q_cohort_totals_watermark,
    "ingest_quarantine": q_ingest_quarantine,
    "ingest_receipt": q_ingest_receipt,
    "quarantine_reasons": q_quarantine_reasons,
    "ingest_bronze": q_ingest_bronze,
    "ndjson_lines": q_ndjson_lines,
    "ndjson_records": q_ndjson_records,
    "warehouse_daily": q_warehouse_daily,
    "warehouse_refresh": q_warehouse_refresh,
    "warehouse_timeline": q_warehouse_timeline,
    "warehouse_export": q_warehouse_export,
    "cohort_retention_filtered": q_cohort_retention_filtered,
    "cohort_totals_filtered": q_cohort_totals_filtered,
    "warehouse_two_batches": q_warehouse_two_batches,
    "warehouse_replay": q_warehouse_replay,
    "warehouse_snapshot": q_warehouse_snapshot,
    "warehouse_refusals": q_warehouse_refusals,
    "ingest_bounds": q_ingest_bounds,
    "cohort_no_data": q_cohort_no_data,
    "null_parts": q_null_parts,
    "contract_rules": q_contract_rules,
    "summary": q_summary,
    "documents_privacy": q_documents_privacy,
    "conversations_privacy": q_conversations_privacy,
    "conversations_credentials": q_conversations_credentials,
    "customer_pseudonyms": q_customer_pseudonyms,
    "customer_pseudonyms_native": q_customer_pseudonyms_native,
    "orders_audit": q_orders_audit,
    "orders_audit_broken": q_orders_audit_broken,
    "orders_violations": q_orders_violations,
    "cohort_header": q_cohort_header,
    "events_audit": q_events_audit,
}
