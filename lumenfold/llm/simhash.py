"""SimHash near-duplicates through an inverted index of byte positions.

A text's fingerprint has 64 bits; bit i is 1 if over half of the hashes of its
word shingles have it. Fingerprints within ``max_bits`` differing bits are
linked, and linked documents form groups.

Candidate search works on distinct fingerprints. A fingerprint is a set of
eight positional bytes. Fingerprints within d bits differ in at most d bytes,
so they share at least 8 - d positional bytes. With the positions dealt into
d + 2 groups, at least two groups are whole, so the pair meets in a posting
list keyed by the bytes of two groups. A pair from a list is kept if the tally
of shared positional bytes reaches 8 - d, and is then verified by its bits.

A posting list with over ``MAX_LIST`` fingerprints would give a quadratic
number of pairs. Its members take an exact other way: two fingerprints within
two bits share a point at one bit's distance or less from both, so every member
names its 65 such points (64 keys with one bit cleared for one bit) and is
linked to the least fingerprint that names the same point. Those links are
within the distance too, connect the same groups, and a point has at most 65
namers, so no list grows.

Null and empty texts have fingerprint 0 and are linked like any other. Repeated
rows and ties share a fingerprint and so a group. Null ids stay null and take
the group's least id.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import map_texts, settle
from lumenfold.llm.components import components

SEED = 42
#: Longest posting list whose pairs are written out.
MAX_LIST = 32
#: Shingles voted on at once.
VOTE_ROWS = 65_536


def fingerprint(data: bytes, words: int = 3) -> int:
    """Signed 64-bit fingerprint of UTF-8 ``data``.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` parts words at space
    and 0x09-0x0D only.
    """
    tokens = data.lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if n == 1:
        hashes = [digest(join(tokens), SEED)]
    else:
        hashes = [digest(join(s), SEED) for s in zip(*(tokens[i:] for i in range(words)))]
    values = np.array(hashes, "<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, n, VOTE_ROWS):
        part = values[at : at + VOTE_ROWS]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, words: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp`` (bigint) per row."""

    def make():
        return lambda texts: {"fp": np.array([fingerprint((t or "").encode(), words) for t in texts], np.int64)}

    return map_texts(df, "fp bigint", make, text, keep)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _mask(positions: list[int]) -> int:
    value = sum(0xFF << (8 * p) for p in positions)
    return value - (1 << 64) if value >> 63 else value


def _postings(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(part, bytes, fp): a row per posting list that a fingerprint is in."""
    groups = [list(range(8))[i :: max_bits + 2] for i in range(max_bits + 2)]
    masks = [_mask(a + b) for i, a in enumerate(groups) for b in groups[i + 1 :]]
    kept = F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m in masks))
    return distinct.select("fp", F.posexplode(kept).alias("part", "bytes"))


def _shared_bytes(a: Column, b: Column) -> Column:
    """Tally of equal positional bytes."""
    x = a.bitwiseXOR(b)
    tally = F.lit(0)
    for p in range(8):
        tally = tally + F.when(x.bitwiseAND(F.lit(_mask([p])).cast("bigint")) == 0, 1).otherwise(0)
    return tally


def _points(fp: Column, max_bits: int) -> Column:
    """Keys that two fingerprints share if and only if they are within ``max_bits`` (1 or 2)."""
    powers = [(1 << i) - (1 << 64 if i == 63 else 0) for i in range(64)]
    bits = [F.lit(p).cast("bigint") for p in powers]
    if max_bits == 2:
        return F.array(*(F.struct(F.lit(0).alias("i"), v.alias("v")) for v in [fp, *(fp.bitwiseXOR(b) for b in bits)]))
    cleared = [fp.bitwiseAND(F.bitwise_not(b)) for b in bits]
    return F.array(*(F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(cleared)))


def links(distinct: DataFrame, max_bits: int = 2, max_list: int = MAX_LIST) -> DataFrame:
    """(a, b) links between distinct fingerprints ``fp`` that connect all within ``max_bits``."""
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    if max_bits == 0:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    postings = _postings(distinct, max_bits)
    sizes = postings.groupBy("part", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    shared = settle(postings.join(sizes, ["part", "bytes"]))
    short = shared.where(F.col("n") <= max_list)
    left = short.select("part", "bytes", F.col("fp").alias("a"))
    right = short.select("part", "bytes", F.col("fp").alias("b"))
    a, b = F.col("a"), F.col("b")
    pairs = (
        left.join(right, ["part", "bytes"])
        .where((a < b) & (_shared_bytes(a, b) >= 8 - max_bits))
        .where(F.bit_count(a.bitwiseXOR(b)) <= max_bits)
        .select("a", "b")
    )
    named = (
        shared.where(F.col("n") > max_list)
        .select("fp")
        .distinct()
        .select("fp", F.explode(_points(F.col("fp"), max_bits)).alias("point"))
        .select("fp", "point.i", "point.v")
    )
    least = named.groupBy("i", "v").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    starred = named.join(least, ["i", "v"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(starred).distinct()


def near_duplicates(
    df: DataFrame, words: int = 3, max_bits: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``df``.

    ``component_id`` is the least id reachable through links, the row's own
    included (null if the group has no id at all).
    """
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = settle(fingerprints(source, words))
    classes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(classes.select("fp"), max_bits))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    groups = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.select("fp", "root").join(groups, "root").select("fp", "component_id")
    return marked.join(named, "fp", "left").select(
        "doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` without all but one of each near-duplicate group.

    The row with the least doc_id stays (null ids come last; among equal ids
    the one with the least text hash). Rows that agree in id and text stay once.
    All columns of ``docs`` are returned as they are.
    """
    row = docs.select(
        "doc_id",
        F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("h")).alias("key"),
        "text",
    )
    marked = settle(fingerprints(row, words, keep=("key",)).select("key.*", "fp"))
    order = F.struct("no_id", "doc_id", "h")
    classes = settle(marked.groupBy("fp").agg(F.min(order).alias("best")))
    roots = components(links(classes.select("fp"), max_bits))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "best", F.coalesce("root", "fp").alias("root")
    )
    best = rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.*")
    # Rows that agree with a chosen one in id and text: seldom more than one.
    many = marked.groupBy("no_id", "doc_id", "h").count().where("count > 1").drop("count")
    many = many.join(best, (many.h == best.h) & many.doc_id.eqNullSafe(best.doc_id), "left_semi")
    chosen = best.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    several = many.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    # Columns go by place, so no name of theirs can clash.
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own_id, own_text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    whole = docs.toDF(*names).select(
        F.struct(*names).alias("_row"), F.col(own_id).alias("_id"), F.xxhash64(own_text).alias("_h")
    )
    same = lambda x: (whole._h == x._h) & whole._id.eqNullSafe(x._id)
    kept = whole.join(chosen, same(chosen), "left_semi")
    single = kept.join(several, (kept._h == several._h) & kept._id.eqNullSafe(several._id), "left_anti")
    once = (
        kept.join(several, (kept._h == several._h) & kept._id.eqNullSafe(several._id), "left_semi")
        .groupBy("_id", "_h")
        # As text, as maps have no order.
        .agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    )
    return single.select("_row").union(once.select("_row")).select("_row.*").toDF(*docs.columns)
