"""Keyed hashing and deterministic identifiers.

``pseudonymizer`` keeps the key out of plans and event logs: it goes to the
executors in a broadcast, to a batched Arrow step. ``pseudonymize`` is the same
function as JVM expressions, with the key's pads as literals of the plan; use it
where plans are as well guarded as the key.
"""

from __future__ import annotations

import hmac
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lumenfold.schema import MINIMUM_SECRET_LENGTH

_BLOCK = 64  # SHA-256 block size in bytes


def check_secret(secret: str) -> str:
    """A key that is too short to keep pseudonyms from being guessed is refused."""
    if len(secret) < MINIMUM_SECRET_LENGTH:
        raise ValueError(f"a key for pseudonyms needs {MINIMUM_SECRET_LENGTH} characters or more, this one has {len(secret)}")
    return secret


def hmac_pads(secret: str) -> tuple[str, str]:
    """Return (inner, outer) HMAC-SHA256 key pads as hex for ``secret``.

    Small driver-side helper: the pads are constants of the query.
    """
    import hashlib

    key = check_secret(secret).encode("utf-8")
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    inner = bytes(b ^ 0x36 for b in key).hex()
    outer = bytes(b ^ 0x5C for b in key).hex()
    return inner, outer


def hmac_sha256_hex(message: Column, secret: str) -> Column:
    """HMAC-SHA256(secret, utf8(message)) as lowercase hex."""
    inner, outer = hmac_pads(secret)
    inner_digest = F.unhex(
        F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(message.cast("string"), "UTF-8")), 256)
    )
    return F.sha2(F.concat(F.unhex(F.lit(outer)), inner_digest), 256)


def pseudonymize(source_id: Column, secret: str) -> Column:
    """Stable keyed pseudonym shaped like a player id: ``ply_`` + 12 hex."""
    return F.concat(F.lit("ply_"), F.substring(hmac_sha256_hex(source_id, secret), 1, 12))


def pseudonymizer(spark: SparkSession, secret: str) -> Callable[[Column], Column]:
    """``pseudonymize`` for one key that appears in no plan, explain output or event log."""
    key = spark.sparkContext.broadcast(check_secret(secret).encode("utf-8"))

    @F.pandas_udf("string")
    def pseudonym(source_id: pd.Series) -> pd.Series:
        own = key.value
        return source_id.map(lambda x: None if x is None else f"ply_{hmac.digest(own, x.encode('utf-8'), 'sha256').hex()[:12]}")

    return lambda source_id: pseudonym(source_id.cast("string"))


def quarantine_id(batch_id: Column, line_number: Column, reason_code: Column) -> Column:
    """``qtn_`` + first 20 hex of sha256("batch:line:reason")."""
    identity = F.concat_ws(":", batch_id, line_number.cast("string"), reason_code)
    return F.concat(F.lit("qtn_"), F.substring(F.sha2(F.encode(identity, "UTF-8"), 256), 1, 20))
