"""Column helpers for text work that stays in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of the runs in which prefix sums are taken, so that they stay near linear.
RUN = 256


def hold(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once.

    A plain projection may be merged into the lambda that uses it and then be
    computed per element; a generator is never merged.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def running(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For an array of n: array of n + 1 results of ``combine`` over the elements before each place.

    ``combine`` is associative and ``zero`` neutral. Runs of ``RUN`` elements are
    taken alone and then combined with the results of the runs before them, which
    keeps the array copies near linear.
    """

    def plain(part: Column) -> Column:
        return F.aggregate(
            part, F.array(zero), lambda done, x: F.concat(done, F.array(combine(F.element_at(done, -1), x)))
        )

    last = F.floor((F.size(values) - 1) / F.lit(RUN)).cast("int")
    spots = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    runs = F.transform(spots, lambda i: F.slice(values, i * RUN + 1, F.lit(RUN)))
    results = F.transform(runs, plain)
    bases = plain(F.transform(results, lambda r: F.element_at(r, -1)))
    lifted = F.zip_with(
        results,
        F.slice(bases, 1, F.size(results)),
        lambda r, base: F.transform(F.slice(r, 1, F.size(r) - 1), lambda x: combine(base, x)),
    )
    return F.concat(F.flatten(lifted), F.array(F.element_at(bases, -1)))


def sums_before(values: Column) -> Column:
    """For array<bigint> of n: array of n + 1 sums of the elements before each place."""
    return running(values, lambda a, b: a + b, F.lit(0).cast("bigint"))


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of struct(start, stop, found), in code points, stop exclusive.

    What stands between the matches and the matches themselves alternate, so
    their lengths give all places. Null where the text has no match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    length = lambda x: F.char_length(x).cast("bigint")
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: length(b) + length(m))
    ends = F.slice(sums_before(steps), 2, F.size(found))
    spans = F.zip_with(ends, found, lambda e, m: F.struct((e - length(m)).alias("start"), e.alias("stop"), m.alias("found")))
    return F.when(F.regexp_like(text, F.lit(pattern)), spans)
