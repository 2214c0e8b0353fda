"""Column-expression helpers (all JVM-side, codegen friendly)."""

from lumenfold.functions.hashing import hmac_sha256_hex, pseudonymize, quarantine_id
from lumenfold.functions.text import concat_skip_nulls, full_match
from lumenfold.functions.timeutil import (
    epoch_millis,
    late_flag,
    minute_diff,
    minute_floor,
    naive_utc,
    second_diff,
    utc_date,
)

__all__ = [
    "concat_skip_nulls",
    "epoch_millis",
    "full_match",
    "hmac_sha256_hex",
    "late_flag",
    "minute_diff",
    "minute_floor",
    "naive_utc",
    "pseudonymize",
    "quarantine_id",
    "second_diff",
    "utc_date",
]
