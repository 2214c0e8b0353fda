"""Repeated passages across documents, by sparse suffix arrays.

A passage is ``MIN_WORDS`` white-space separated words or more that stand in two
documents. Of every ``MIN_WORDS`` consecutive words the content selects at least
one suffix: the k-gram (``GRAM`` words) of least hash in that window, a
minimiser. Only these suffixes are kept, one in about twenty, each with its k-gram
hash and with the codes of the words to its left and right that a passage can
need.

Suffixes whose k-gram stands in one document only are dropped. The rest are sorted
by k-gram and right context, neighbours are compared, and matches are extended
right and left; ``MIN_WORDS`` or more make a repeated span around the suffix. All
members of a group of equal k-grams are compared with the neighbours that follow
in it, as the longest extension to both sides need not be the next one's.

Groups of over ``MAX_GROUP`` suffixes take an exact other way that is linear in
their size: every member names the windows of ``MIN_WORDS`` words whose least
k-gram it is, equal windows are counted by a salted aggregate, and those in
two documents are repeated. Suffixes of the most frequent k-grams (at most
``HOT_KEYS`` of them) go there before any shuffle.

Both ways find a window if and only if it stands in two documents, up to hash
equality (64 bits for k-grams and windows, 16 bits for each word of a context, so
a span's end can be a word too far with a chance of 2 ** -16).

Links: the documents that share a window form a star around the least of them, so
every document of a repeated window is linked, and no window's link is lost where
spans of several passages overlap.

Null and empty texts have no spans. Rows of one doc_id are one document, so copies
within it don't count. Rows without id are a document per distinct text; they count
as partners, and their own result rows have a null id. Ids are 64-bit numbers of
which those below ``NO_ID`` are kept for that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfold.llm.common import _steps, settle, ship

MIN_WORDS = 50
GRAM = 8
#: Words of context kept on each side beyond the k-gram.
SIDE = MIN_WORDS - GRAM
#: k-grams per window: of these the least is selected.
WINDOW = MIN_WORDS - GRAM + 1
MAX_GROUP = 32
HOT_KEYS = 100_000
#: Tasks that the rows of one window are dealt to.
SALTS = 16
#: Keys of rows without id are below this.
NO_ID = -(1 << 62)
_NONE = np.iinfo(np.int64).max

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


#: Bytes whose powers are held at once.
CODE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd number modulo 2 ** 64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n, CODE_BYTES) + 1
        bases = (_BASE, pow(_BASE, -1, 1 << 64))
        found = [np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, b, np.uint64))) for b in bases]
        if n > CODE_BYTES:
            return found[0], found[1]
        _POWERS[:] = found
    return _POWERS[0], _POWERS[1]


def _codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes, 64-bit codes) of the words of some UTF-8 bytes: differences of a running polynomial."""
    word = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    first, stop = edges[::2], edges[1::2]
    power, back = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return first, _mix((total[stop] - total[first]) * back[first] + (stop - first).astype(np.uint64) * _ODD)


def word_codes(texts: list[str]) -> list[np.ndarray]:
    """A 64-bit code per word of each text; equal words have equal codes wherever they stand."""
    raw = [t.encode("utf-8") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    firsts, codes, low = [], [], 0
    while low < len(data):
        high = min(low + CODE_BYTES, len(data))
        if high < len(data):
            # A block ends with a word's end: the last in it, or the first after it.
            inside = np.flatnonzero(_SPACE[data[low:high]])
            high = low + int(inside[-1]) + 1 if len(inside) else high
            while not len(inside):
                more = np.flatnonzero(_SPACE[data[high : high + CODE_BYTES]])
                high += int(more[0]) + 1 if len(more) else CODE_BYTES
                inside = more
        first, code = _codes(data[low:high])
        firsts.append(first + low)
        codes.append(code)
        low = high
    ends = np.cumsum([len(r) + 1 for r in raw])
    cuts = np.searchsorted(np.concatenate(firsts), ends) if firsts else []
    return np.split(np.concatenate(codes), cuts[:-1]) if texts else []


def select(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, k-gram hashes, first and last window start) of the selected suffixes of one text.

    The windows whose least k-gram is at a place start at consecutive words.
    """
    n = len(codes) - GRAM + 1
    if len(codes) < MIN_WORDS:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    grams = np.zeros(n, np.uint64)
    for i in range(GRAM):
        grams = grams * _ODD + codes[i : i + n]
    grams = _mix(grams)
    least = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).argmin(axis=1) + np.arange(n - WINDOW + 1)
    places, first = np.unique(least, return_index=True)
    return places, grams[places], first, np.append(first[1:], len(least)) - 1


def contexts(codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) uint16 codes beside each k-gram, from it outwards; 0 is beyond the text."""
    short = (codes % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
    padded = np.concatenate([np.zeros(SIDE, np.uint16), short, np.zeros(SIDE, np.uint16)])
    side = np.arange(SIDE)
    return padded[places[:, None] + SIDE - 1 - side], padded[places[:, None] + SIDE + GRAM + side]


_KEYS = "gram bigint, doc_id bigint"
_ROWS = "gram bigint, doc_id bigint, place int, first int, last int, left binary, right binary"


def suffixes(docs: DataFrame, narrow: bool = False) -> DataFrame:
    """The selected suffixes of (doc_id, text) rows; ``narrow``: k-gram and document only."""
    ship(docs.sparkSession)
    without = F.lit(NO_ID) - 1 - F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    source = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), without).alias("doc_id"), "text").where("text is not null")

    def run(batches):
        for batch in batches:
            for start, end, texts in _steps(batch.column(1), 1_000_000):
                ids, found = batch.column(0).slice(start, end - start).to_pylist(), []
                for doc_id, codes in zip(ids, word_codes(texts)):
                    places, *others = select(codes)
                    if len(places):
                        found.append((doc_id, places, *others, *(contexts(codes, places) if not narrow else ())))
                if not found:
                    continue
                grams = np.concatenate([f[2] for f in found]).view(np.int64)
                owner = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                columns = {"gram": pa.array(grams), "doc_id": pa.array(owner, pa.int64())}
                if not narrow:
                    for name, i in (("place", 1), ("first", 3), ("last", 4)):
                        columns[name] = pa.array(np.concatenate([f[i] for f in found]), pa.int32())
                    for name, i in (("left", 5), ("right", 6)):
                        data = np.concatenate([f[i] for f in found])
                        fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * SIDE), len(data), [None, pa.py_buffer(data.tobytes())])
                        columns[name] = fixed.cast(pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return source.mapInArrow(run, _KEYS if narrow else _ROWS)


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal codes from the start of each pair of rows; what lies beyond a text is equal to nothing."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _compare(rows: pa.Table) -> pa.RecordBatch | None:
    """Spans from whole groups, sorted by k-gram: each row's widest repeated span, once per partner.

    A row's partners are, over the windows around its suffix, the least other
    document with that window.
    """
    n = rows.num_rows
    gram, doc, place = (np.asarray(rows.column(c)) for c in ("gram", "doc_id", "place"))
    side = lambda c: np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint16).reshape(n, SIDE)
    left, right = side("left"), side("right")
    low, high = np.full(n, _NONE), np.zeros(n, np.int64)
    # By the words that a window has before the suffix.
    least = np.full((n, WINDOW), _NONE)
    offset = np.arange(WINDOW)
    at, step = np.arange(n), 0
    while True:
        step += 1
        at = at[at + step < n]
        at = at[gram[at] == gram[at + step]]
        if not len(at):
            break
        a = at[doc[at] != doc[at + step]]
        b = a + step
        before, after = _same(left[a], left[b]), _same(right[a], right[b])
        good = before + GRAM + after >= MIN_WORDS
        a, b, before, after = a[good], b[good], before[good], after[good]
        within = (offset <= before[:, None]) & (offset >= SIDE - after[:, None])
        for x, y in ((a, b), (b, a)):
            low[x] = np.minimum(low[x], place[x] - before)
            high[x] = np.maximum(high[x], place[x] + GRAM + after)
            least[x] = np.minimum(least[x], np.where(within, doc[y][:, None], _NONE))
    got = np.flatnonzero(high)
    if not len(got):
        return None
    partners = np.sort(least[got], axis=1)
    fresh = partners != _NONE
    fresh[:, 1:] &= partners[:, 1:] != partners[:, :-1]
    row = got[np.nonzero(fresh)[0]]
    values = (doc[row], low[row], high[row], partners[fresh])
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], names=["doc_id", "start", "stop", "partner"])


_SPANS = "doc_id bigint, start bigint, stop bigint, partner bigint"


def _neighbours(batches):
    """Compare groups as they stream by in k-gram order; the last group of a batch waits for the next."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        grams = np.asarray(table.column("gram"))
        cut = int(np.flatnonzero(grams == grams[-1])[0]) if len(grams) else 0
        rest = table.slice(cut)
        if cut and (found := _compare(table.slice(0, cut))) is not None:
            yield found
    if rest is not None and rest.num_rows and (found := _compare(rest)) is not None:
        yield found


def _windows(batches):
    """The windows whose least k-gram a suffix starts with: hash, document and first word."""
    for batch in batches:
        rows = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        out: tuple[list, ...] = ([], [], [])
        for gram, doc, place, first, last, left, right in zip(*rows):
            seed = gram & 0xFFFFFFFFFFFFFFFF
            for start in range(first, last + 1):
                d = place - start
                words = left[: 2 * d] + right[: 2 * (SIDE - d)]
                out[0].append(xxhash.xxh64_intdigest(words, seed) ^ d)
                out[1].append(doc)
                out[2].append(start)
        hashes = np.array(out[0], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["window", "doc_id", "start"]
        )


def repeated_spans(docs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """(doc_id, start, stop, partner) spans of words, not merged: a row per span and partner that links it."""
    keys = suffixes(docs, narrow=True).groupBy("gram").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")
    )
    keys = settle(keys.where("a <> b").select("gram", "n"))
    total = keys.agg(F.sum("n")).first()[0] or 0
    # No more than HOT_KEYS k-grams can have more than this many suffixes.
    limit = max(max_group, total // HOT_KEYS)
    hot = F.broadcast(keys.where(F.col("n") > limit).select("gram", F.lit(True).alias("hot")))
    rows = suffixes(docs).join(hot, "gram", "left")
    cold = rows.where("hot is null").drop("hot").join(keys.where(F.col("n") <= limit), "gram")
    small = cold.where(F.col("n") <= max_group)
    order = W.partitionBy("gram").orderBy("right", "left", "doc_id", "place")
    # The row number asks for whole groups in order; the comparison needs nothing else of it.
    ordered = small.withColumn("rank", F.row_number().over(order)).where("rank > 0")
    spans = ordered.mapInArrow(_neighbours, _SPANS)
    columns = ["gram", "doc_id", "place", "first", "last", "left", "right"]
    large = rows.where("hot").select(columns).union(cold.where(F.col("n") > max_group).select(columns))
    windows = large.mapInArrow(_windows, "window bigint, doc_id bigint, start bigint")
    # A passage of very many copies is dealt to SALTS tasks, in the counts and in the join.
    windows = windows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    ends = F.min("doc_id").alias("a"), F.max("doc_id").alias("b")
    parts = windows.groupBy("window", "salt").agg(*ends)
    # At most SALTS rows of a window are left here.
    whole = W.partitionBy("window")
    shared = parts.withColumn("a", F.min("a").over(whole)).withColumn("b", F.max("b").over(whole)).where("a <> b")
    wide = windows.join(shared, ["window", "salt"]).select(
        "doc_id",
        "start",
        (F.col("start") + MIN_WORDS).alias("stop"),
        F.when(F.col("a") != F.col("doc_id"), F.col("a")).otherwise(F.col("b")).alias("partner"),
    )
    return spans.union(wide)


def repeated_passages(docs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """Per document with repeats: doc_id, ``spans`` (array of struct(start, stop), merged, in words),
    ``n_words`` (words in them) and ``partners`` (ids of the documents that it is linked to, in order).

    Documents that share a window are linked to the least of them, so they are
    connected through ``partners`` whatever else they share.
    """
    spans = repeated_spans(docs, max_group)
    order = W.partitionBy("doc_id").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    # Spans that touch are not merged: what joins two passages stands in neither.
    fresh = F.when(F.col("start") < reach, 0).otherwise(1)
    parts = spans.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(order))
    known = F.when(F.col("partner") >= NO_ID, F.col("partner"))
    merged = parts.groupBy("doc_id", "part").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.collect_set(known).alias("with")
    )
    return merged.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"),
        F.sum(F.col("stop") - F.col("start")).alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("with")))).alias("partners"),
    ).select(F.when(F.col("doc_id") >= NO_ID, F.col("doc_id")).alias("doc_id"), "spans", "n_words", "partners")
