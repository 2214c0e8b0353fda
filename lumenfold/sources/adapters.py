"""Map the driver's generic ``events`` table onto event contract v1.

The mapping is deterministic and purely column-wise (no shuffle), so it scales
with the scan. ``k`` is the integer in ``props`` (0..99):

* ids: ``evt_`` + 16 hex of event_id, ``ply_`` + 12 hex of user_id
* event_type: signup, view, click, purchase, error ->
  session_start, level_start, level_complete, purchase, reset
* event_time = ts (naive UTC); received_at = ts + 15 minutes * k
* game_version by user_id % 2, platform by user_id % 3
* level = 1 + k % 10 for level_start/level_complete/reset
* amount_cents = round(value * 100), currency USD for purchases
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.timeutil import late_flag
from lumenfold.schema import LATE_ARRIVAL_HOURS, SCHEMA_VERSION
from lumenfold.sources.tables import EVENTS_COLUMNS, read_table, spread

# Fixed values of the adapter.
TYPE_MAP = {
    "signup": "session_start",
    "view": "level_start",
    "click": "level_complete",
    "purchase": "purchase",
    "error": "reset",
}
VERSIONS = ("1.4.0", "2.0.0")
PLATFORM_BY_MOD3 = ("pc", "console", "mobile")
ARRIVAL_STEP_MINUTES = 15
ADAPTER_BATCH_ID = "events"


def _mapped_type(source: Column) -> Column:
    expr = None
    for src, dst in TYPE_MAP.items():
        expr = (F.when(source == src, F.lit(dst)) if expr is None else expr.when(source == src, F.lit(dst)))
    return expr


def contract_columns(events: DataFrame, keep=(), keep_as=()) -> DataFrame:
    """Typed v1 envelope columns (event_id .. reason) from driver events;
    ``keep`` source columns are carried along under the ``keep_as`` names."""
    k = F.get_json_object("props", "$.k").cast("int")
    etype = _mapped_type(F.col("event_type"))
    event_time = F.col("ts").cast("timestamp")
    return events.select(
        *[F.col(c).alias(a) for c, a in zip(keep, keep_as)],
        F.concat(F.lit("evt_"), F.lpad(F.lower(F.hex("event_id")), 16, "0")).alias("event_id"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.concat(F.lit("ply_"), F.lpad(F.lower(F.hex("user_id")), 12, "0")).alias("player_id"),
        etype.alias("event_type"),
        event_time.alias("event_time"),
        F.timestamp_add("MINUTE", k * ARRIVAL_STEP_MINUTES, event_time).alias("received_at"),
        F.when(F.col("user_id") % 2 == 0, F.lit(VERSIONS[0])).otherwise(F.lit(VERSIONS[1])).alias(
            "game_version"
        ),
        F.when(F.col("user_id") % 3 == 0, F.lit(PLATFORM_BY_MOD3[0]))
        .when(F.col("user_id") % 3 == 1, F.lit(PLATFORM_BY_MOD3[1]))
        .otherwise(F.lit(PLATFORM_BY_MOD3[2]))
        .alias("platform"),
        F.when(F.col("event_type").isin("view", "click", "error"), 1 + k % 10).alias("level"),
        F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100).cast("int")).alias(
            "amount_cents"
        ),
        F.when(F.col("event_type") == "purchase", F.lit("USD")).alias("currency"),
        F.lit(None).cast("string").alias("reason"),
    )


def bronze_from_events(events: DataFrame, batch_id: str = ADAPTER_BATCH_ID) -> DataFrame:
    """Accepted-event rows (bronze schema) straight from the driver table."""
    env = contract_columns(events)
    return env.select(
        "*",
        late_flag("event_time", "received_at", LATE_ARRIVAL_HOURS).alias("is_late"),
        F.lit(batch_id).alias("batch_id"),
        F.lit("").alias("raw_payload"),
    )


def load_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze_from_events(read_table(spark, sf_dir, "events", EVENTS_COLUMNS))


# Fixed corruption plan for raw lines (checked in this precedence order).
CORRUPT_INVALID_JSON = 97  # line is not JSON
CORRUPT_NOT_OBJECT = 89  # root is an array
CORRUPT_SENSITIVE_KEY = 83  # extra "contact_email" key with an e-mail value
CORRUPT_BAD_ID = 79  # event_id not matching the contract pattern
CORRUPT_PHONE_VALUE = 71  # phone number inside properties.reason
CORRUPT_DUPLICATE = 73  # the line is emitted twice
RAW_BATCH_ID = "events-raw"
ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"


def raw_event_lines(events: DataFrame, batch_id: str = RAW_BATCH_ID) -> DataFrame:
    """Canonical NDJSON lines ``(batch_id, line_number, raw)`` for the driver
    events, with deterministic corruptions keyed on the integer event id.

    Line numbers are ``2 * id + 1`` (``+ 1`` for a duplicate's second copy);
    the gaps behave like blank lines. Pure projection + explode: no shuffle. The
    copies are made of the narrow rows: a filter by line number is then applied
    before lines are built, not after.
    """
    twice = F.col("event_id") % CORRUPT_DUPLICATE == 0
    copies = F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    copied = events.select("*", F.explode(copies).alias("copy"))
    typed = contract_columns(copied, keep=("event_id", "copy"), keep_as=("src_id", "copy"))
    sid = F.col("src_id")
    reason = F.when(sid % CORRUPT_PHONE_VALUE == 0, F.lit("call 619-555-0101"))
    record = typed.select(
        "src_id",
        "copy",
        F.when(sid % CORRUPT_SENSITIVE_KEY == 0, F.lit("player@example.test")).alias("contact_email"),
        F.when(sid % CORRUPT_BAD_ID == 0, F.upper("event_id")).otherwise(F.col("event_id")).alias("event_id"),
        F.date_format("event_time", ISO_UTC).alias("event_time"),
        "event_type",
        "game_version",
        "platform",
        "player_id",
        F.struct(
            F.col("amount_cents").alias("amount_cents"),
            F.col("currency").alias("currency"),
            F.col("level").alias("level"),
            reason.alias("reason"),
        ).alias("properties"),
        F.date_format("received_at", ISO_UTC).alias("received_at"),
        F.col("schema_version"),
    )
    from lumenfold.sources.ndjson import canonical_json  # local: avoids an import cycle

    body = canonical_json(record.drop("src_id", "copy"), nulls=False)
    raw = (
        F.when(sid % CORRUPT_INVALID_JSON == 0, F.concat(F.lit('{"event_id": broken '), sid.cast("string")))
        .when(sid % CORRUPT_NOT_OBJECT == 0, F.concat(F.lit("["), sid.cast("string"), F.lit("]")))
        .otherwise(body)
    )
    return record.select(
        F.lit(batch_id).alias("batch_id"),
        (F.col("src_id") * 2 + 1 + F.col("copy")).cast("bigint").alias("line_number"),
        raw.alias("raw"),
    )


def load_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The narrow rows are dealt out, not the lines that are built of them.
    return raw_event_lines(spread(read_table(spark, sf_dir, "events", EVENTS_COLUMNS)))


# Fixed plan of one change per line for the contract rules: by event id modulo the
# number of cases, the piece that is changed and its new text (others stay valid).
RULE_CASES: tuple[tuple[str, str], ...] = (
    ("", ""),
    ("properties", '{"level":3000000000}'),
    ("event_time", '"12:00:00Z"'),
    ("event_time", "1000000000000000000"),
    ("properties", '{"level":9,"level":2}'),
    ("properties", r'{"level":" 3\t"}'),
    ("properties", '{"level":"1_0"}'),
    ("properties", '{"level":2.5}'),
    ("properties", "{}"),
    ("platform", '"toaster"'),
    ("event_type", '"fly"'),
    ("extra", ',"zz":1'),
    ("properties", '{"level":3,"q":1}'),
    ("event_time", '"2026-01-01T00:00:00"'),
    ("received_at", '"2001-01-01T00:00:00Z"'),
    ("schema_version", "2"),
    ("schema_version", "null"),
    ("schema_version", "99999999999"),
    ("properties", "[]"),
    ("properties", '{"level":3,"currency":"usd"}'),
    ("extra", ',"pa\u017f\u017fword":1'),
    ("event_time", '"2026-01-01T10:00:00+20:00"'),
    ("event_type", '"purchase"'),
    ("properties", '{"level":3,"reason":""}'),
    ("event_time", '"2026-8-1T2:0:0Z"'),
    ("player_id", '"someone"'),
    ("game_version", "7"),
)


def rule_lines(events: DataFrame, batch_id: str = "rules") -> DataFrame:
    """A line per driver event, changed by RULE_CASES; ``(batch_id, line_number, raw)``."""
    case = F.pmod(F.col("event_id"), F.lit(len(RULE_CASES))).cast("int")
    pieces = {
        "event_id": F.concat(F.lit('"evt_'), F.lpad(F.lower(F.hex("event_id")), 16, "0"), F.lit('"')),
        "event_time": F.lit('"2026-01-01T00:00:00+00:00"'),
        "event_type": F.lit('"level_start"'),
        "game_version": F.lit('"1.2.3"'),
        "platform": F.lit('"pc"'),
        "player_id": F.lit('"ply_00000000000a"'),
        "properties": F.lit('{"level":3}'),
        "received_at": F.lit('"2026-01-01T00:00:05+00:00"'),
        "schema_version": F.lit("1"),
        "extra": F.lit(""),
    }
    for n, (piece, text) in enumerate(RULE_CASES):
        if piece:
            pieces[piece] = F.when(case == n, F.lit(text)).otherwise(pieces[piece])
    extra = pieces.pop("extra")
    joined = [F.concat(F.lit(f'"{name}":'), value) for name, value in pieces.items()]
    raw = F.concat(F.lit("{"), F.concat_ws(",", *joined), extra, F.lit("}"))
    return events.select(F.lit(batch_id).alias("batch_id"), (F.col("event_id") + 1).alias("line_number"), raw.alias("raw"))
