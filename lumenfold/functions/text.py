"""String helpers with the metric layer's NULL semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat_skip_nulls(*parts: Column | str) -> Column:
    """Concatenate, treating NULL parts as empty strings.

    The reference dialect's ``concat`` skips NULLs, Spark's ``concat`` returns
    NULL; ``concat_ws('')`` has the required behaviour.
    """
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("", *[c.cast("string") for c in cols])


def full_match(column: Column, pattern: str) -> Column:
    """Whole-string regex match. Java's ``$`` also matches before a final newline,
    so anchors are rewritten to ``\\A``/``\\z``."""
    body = pattern
    if body.startswith("^"):
        body = body[1:]
    if body.endswith("$"):
        body = body[:-1]
    return column.rlike(r"\A(?:" + body + r")\z")
