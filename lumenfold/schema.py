"""Event contract v1: types, enums and the fixed constants of the metric layer."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the contract's published definitions).
# ---------------------------------------------------------------------------
EVENT_ID_PATTERN = r"^evt_[0-9a-f]{16}$"
PLAYER_ID_PATTERN = r"^ply_[0-9a-f]{12}$"
GAME_VERSION_PATTERN = r"^[0-9]+\.[0-9]+\.[0-9]+$"
CURRENCY_PATTERN = r"^[A-Z]{3}$"
EVENT_TYPES = ("session_start", "level_start", "level_complete", "purchase", "reset")
PLATFORMS = ("pc", "console", "mobile")
LEVEL_RANGE = (1, 1000)
AMOUNT_RANGE = (0, 100000)
REASON_LENGTH = (1, 80)
SCHEMA_VERSION = 1
LATE_ARRIVAL_HOURS = 24
SESSION_GAP_MINUTES = 30
CHURN_DAYS = 3
BURST_THRESHOLD = 20
RETENTION_DAYS = (0, 1, 7)
MAX_RAW_PAYLOAD_CHARS = 20000
MAX_DETAIL_CHARS = 2000
MAX_BATCH_ID_CHARS = 80
BATCH_ID_STRICT_PATTERN = r"[A-Za-z0-9][A-Za-z0-9_.:-]{0,79}"
MAX_VERSION_LENGTH = 32
MINIMUM_SECRET_LENGTH = 16
DEFAULT_RESULT_LIMIT = 100
# Funnel stages: (stage_order, stage, event_type)
FUNNEL_STAGES = (
    (1, "session", "session_start"),
    (2, "level_started", "level_start"),
    (3, "level_completed", "level_complete"),
    (4, "purchase", "purchase"),
)
# Quarantine reason codes, in routing precedence order.
REASON_CODES = (
    "invalid_json",
    "invalid_shape",
    "privacy_violation",
    "contract_violation",
    "duplicate_event",
)
ENVELOPE_FIELDS = (
    "event_id",
    "schema_version",
    "player_id",
    "event_type",
    "event_time",
    "received_at",
    "game_version",
    "platform",
    "properties",
)
PROPERTY_FIELDS = ("level", "amount_cents", "currency", "reason")
GOLD_TABLES = (
    "gold_sessions",
    "gold_daily_metrics",
    "gold_retention",
    "gold_funnel",
    "gold_player_summary",
    "gold_anomaly_candidates",
)

# ---------------------------------------------------------------------------
# Stored table schemas.
# ---------------------------------------------------------------------------
RECEIPTS = T.StructType(
    [
        T.StructField("batch_id", T.StringType(), False),
        T.StructField("source_sha256", T.StringType(), False),
        T.StructField("started_at", T.TimestampType(), False),
        T.StructField("completed_at", T.TimestampType(), False),
        T.StructField("received_count", T.LongType(), False),
        T.StructField("accepted_count", T.LongType(), False),
        T.StructField("quarantine_count", T.LongType(), False),
    ]
)

BRONZE = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("schema_version", T.IntegerType(), False),
        T.StructField("player_id", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("event_time", T.TimestampType(), False),
        T.StructField("received_at", T.TimestampType(), False),
        T.StructField("game_version", T.StringType(), False),
        T.StructField("platform", T.StringType(), False),
        T.StructField("level", T.IntegerType(), True),
        T.StructField("amount_cents", T.IntegerType(), True),
        T.StructField("currency", T.StringType(), True),
        T.StructField("reason", T.StringType(), True),
        T.StructField("is_late", T.BooleanType(), False),
        T.StructField("batch_id", T.StringType(), False),
        T.StructField("raw_payload", T.StringType(), False),
    ]
)

QUARANTINE = T.StructType(
    [
        T.StructField("quarantine_id", T.StringType(), False),
        T.StructField("batch_id", T.StringType(), False),
        T.StructField("line_number", T.LongType(), False),
        T.StructField("reason_code", T.StringType(), False),
        T.StructField("details", T.StringType(), False),
        T.StructField("raw_payload", T.StringType(), False),
        T.StructField("quarantined_at", T.TimestampType(), False),
    ]
)

BRONZE_COLUMNS = [f.name for f in BRONZE.fields]
SILVER_COLUMNS = [
    "event_id",
    "player_id",
    "event_type",
    "event_time",
    "received_at",
    "event_date",
    "arrival_lag_seconds",
    "game_version",
    "platform",
    "level",
    "amount_cents",
    "currency",
    "reason",
    "is_late",
    "batch_id",
    "event_sequence",
]
