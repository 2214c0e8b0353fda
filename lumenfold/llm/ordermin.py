"""Document fingerprints by order MinHash.

A text is a sequence of tokens (runs of at most ``TOKEN`` characters that are not
white space) and its k-mers are K tokens long. Equal k-mers are numbered by
occurrence in text order, so each (k-mer, number) is one element. Every sketch
orders the elements by hash and takes the ``TAKE`` least; their k-mers, put back
into text order and hashed together, are one entry of the signature. Entries agree
when two texts share k-mers in the same order, which follows edit distance and not
only the set of k-mers.

The orders come from one hash of the element: sketch j starts at the j-th of
``SKETCHES`` equal arcs of the hash circle and goes round from there. Each is an
ordering of all elements, none is ever empty, and one sort serves them all.

Everything is DataFrame functions within a row: sorts are on arrays of 64-bit
numbers that hold 34 bits of hash and 30 bits of position, and no step is more
than linear beside these sorts. Fewer than K tokens count as one k-mer; null and
empty texts have the signature of no element, equal among themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfold.llm.textops import hold

TOKEN = 12
K = 5
TAKE = 2
#: Signature entries; a power of two.
SKETCHES = 64
_ARC_BITS = SKETCHES.bit_length() - 1
_PLACE_BITS = 30
_PLACE = (1 << _PLACE_BITS) - 1

#: Rows that a stretch of ids aims at, the quantiles that stretches are based on, and the most stretches.
SPAN_ROWS = 4096
QUANTILES = 64
MAX_SPANS = 65_536


def _pack(hashed: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftright(hashed, _PLACE_BITS), _PLACE_BITS).bitwiseOR(place.cast("bigint"))


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(_PLACE).cast("bigint")).cast("int")


def _arc(packed: Column) -> Column:
    """Which arc of the circle an element is on, from 0, in sort order."""
    return F.shiftright(packed, 64 - _ARC_BITS).cast("int") + SKETCHES // 2


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _upto(n: Column) -> Column:
    """0 .. n - 1 as an array."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def with_signature(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: array<int> of SKETCHES entries for the text column.

    Helper columns start with ``_`` and are dropped.
    """
    columns = df.columns
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"\S{{1,{TOKEN}}}"), F.lit(0))
    df = hold(df, "_t", F.transform(tokens, lambda x: F.xxhash64(x)))
    t = F.col("_t")
    spots = _upto(F.size(t) - (K - 1))
    grams = F.transform(spots, lambda i: F.xxhash64(*(F.get(t, i + j) for j in range(K))))
    df = hold(df, "_k", F.when(F.size(t) >= K, grams).when(F.size(t) > 0, F.array(F.xxhash64(t))).otherwise(_none()))
    # Equal k-mers in text order, then every element by its own hash.
    df = hold(df, "_s", F.sort_array(F.transform("_k", lambda h, i: _pack(h, i))))
    s, n = F.col("_s"), F.size("_s")
    kmer = lambda i: F.shiftright(F.get(s, i), _PLACE_BITS)
    df = hold(df, "_f", F.filter(_upto(n), lambda i: (i == 0) | (kmer(i) != kmer(i - 1))))
    numbered = lambda a, b: F.transform(
        F.sequence(a, b - 1), lambda i: _pack(F.xxhash64(kmer(i), i - a), _place(F.get(s, i)))
    )
    f = F.col("_f")
    runs = F.zip_with(f, F.concat(F.slice(f, 2, F.greatest(F.size(f), F.lit(1))), F.array(n)), numbered)
    df = hold(df, "_e", F.sort_array(F.when(n > 0, F.flatten(runs)).otherwise(_none())))
    e = F.col("_e")
    arc = lambda i: _arc(F.get(e, i))
    df = hold(df, "_h", F.filter(_upto(n), lambda i: (i == 0) | (arc(i) != arc(i - 1))))

    def entry(i: Column) -> Column:
        # The TAKE elements from i on round the circle, in text order.
        steps = F.sequence(F.lit(0), F.least(F.lit(TAKE), n) - 1)
        places = F.array_sort(F.transform(steps, lambda o: _place(F.get(e, (i + o) % n))))
        whole = F.xxhash64(F.transform(places, lambda p: F.get(F.col("_k"), p)))
        return whole.bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint")).cast("int")

    # An element that is first on its arc also serves the empty arcs before it.
    firsts = F.flatten(
        F.transform("_h", lambda i: F.array_repeat(entry(i), arc(i) - F.when(i == 0, F.lit(-1)).otherwise(arc(i - 1))))
    )
    rest = F.array_repeat(entry(F.lit(0)), SKETCHES - 1 - arc(n - 1))
    empty = F.array_repeat(F.lit(-1), SKETCHES)
    df = hold(df, name, F.when(n > 0, F.concat(firsts, rest)).otherwise(empty))
    return df.select(*columns, name)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signature entries, 0 to 1."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)
    return F.size(same) / F.lit(float(SKETCHES))


def hex_signature(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def _spans(df: DataFrame, order: str) -> DataFrame:
    """Add ``_span``: consecutive numbers of stretches of the ``order`` column, with about SPAN_ROWS rows or more.

    Quantiles give coarse stretches with equal numbers of rows, equal id ranges
    divide each; the number is monotonic in the id and null ids come first.
    """
    steps = [i / QUANTILES for i in range(QUANTILES + 1)]
    total, marks = df.agg(F.count("*"), F.percentile_approx(order, steps)).first()
    if not marks:
        return df.withColumn("_span", F.lit(0))
    parts = min(MAX_SPANS // QUANTILES, max(1, -(-total // (QUANTILES * SPAN_ROWS))))
    at = F.col(order)
    edges = F.array(*(F.lit(m).cast("bigint") for m in marks))
    inner = F.array(*(F.lit(m).cast("bigint") for m in marks[1:-1]))
    coarse = F.size(F.filter(inner, lambda m: m <= at))
    low, high = F.get(edges, coarse).cast("double"), F.get(edges, coarse + 1).cast("double")
    fine = F.floor((at.cast("double") - low) / (high - low + 1) * parts).cast("int")
    fine = F.greatest(F.lit(0), F.least(F.lit(parts - 1), fine))
    return df.withColumn("_span", F.coalesce(coarse * parts + fine + 1, F.lit(0)))


def with_next(df: DataFrame, order: str, derive: Callable[[DataFrame], DataFrame], values: list[str], name: str) -> DataFrame:
    """``derive(df)`` with ``name``: a struct of ``values`` of the next row by ``order`` (after the last: the first).

    Rows are dealt to stretches of the order, which takes one shuffle; next rows
    are found within a stretch, and the last row of each takes the first of the
    next stretch that has any. Nulls come first, ties stand in order of the values.
    """
    spread = _spans(df, order)
    starts = spread.groupBy("_span").agg(F.min(order).alias("_id"))
    every = W.orderBy("_span")  # MAX_SPANS rows of two numbers at most
    follow = F.coalesce(F.lead("_span").over(every), F.first("_span").over(every))
    starts = starts.select("_span", "_id", follow.alias("_follow"))
    whole = derive(spread)
    by = [F.col(order).asc_nulls_first(), *values]
    inside = whole.withColumn("_next", F.lead(F.struct(*values)).over(W.partitionBy("_span").orderBy(*by)))
    at = F.broadcast(starts.select(F.col("_span").alias("_s"), F.col("_id").alias("_i")))
    first = spread.join(at, (F.col("_span") == F.col("_s")) & F.col(order).eqNullSafe(F.col("_i"))).drop("_s", "_i")
    first = derive(first).groupBy(F.col("_span").alias("_follow")).agg(F.min(F.struct(*values)).alias("_first"))
    ends = starts.select("_span", "_follow").join(first, "_follow").select("_span", "_first")
    joined = inside.join(ends, "_span", "left")
    return joined.withColumn(name, F.coalesce("_next", "_first")).drop("_next", "_first", "_span")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    ``docs`` has doc_id and text. The edited text has the last floor(n / 2) code
    points replaced by the first as many (or all) of the next document in order of
    doc_id. Null texts are empty.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = with_next(rows, "doc_id", lambda d: with_signature(d, "text", "sig"), ["text", "sig"], "next")
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = joined.select(
        "doc_id", size.cast("bigint").alias("n_chars"), edited.alias("edited"), "sig", F.col("next.sig").alias("next_sig")
    )
    signed = with_signature(rows, "edited", "edited_sig")
    return signed.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        hex_signature(F.col("sig")).alias("fingerprint"),
        hex_signature(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
