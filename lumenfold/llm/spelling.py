"""Spelling variants: words one edit apart, by blocked Gram matrices of letter counts.

Words are maximal runs of ``LETTERS``, A-Z lower-cased. Two words are near if
they differ by exactly one inserted, deleted or replaced code point. Then their
letter counts differ by a squared distance of 1 (lengths b and b + 1) or 2 (both
of length b), and all but one of ``SEGMENTS`` stretches of the shorter word stand
at the same end of the other. So a block is a length b, a stretch that may differ,
and what stands around it; it holds the words of length b and b + 1 that agree
there, which bounds it by the letters that fit in one stretch and not by the
table. In a block the product of the letter-count rows with themselves gives all
squared distances (blocks of one size in one batched product); pairs at most two
apart whose lengths fit are kept, and their edit is verified letter by letter. A
pair can agree around two stretches (an insertion into a run of one letter); it
is taken in the first that holds its first difference, so no pair comes twice.

Blocks of over ``TILE`` words are dealt by a hash of the word to tiles, and every
two tiles are a unit of work of their own, so no task needs a whole block and no
pair is lost. Pairs that aren't near never leave their task.

A word's form is its near word of largest count, ties to the smallest in
code-point order, if that count is at least ``FORM_RATIO`` times its own. Counts
grow along forms, so chains are short and end; their ends are found by pointer
doubling, a join per round, each round written to the checkpoint folder.

Null and empty texts have no words; a null id counts as an empty one; repeated
rows count each time; empty tables give empty ones. Words of any length are
handled; those longer than ``SHORT`` are verified one pair at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import settle, ship

LETTERS = r"[A-Za-zÀ-ÿ]+"
SEGMENTS = 3
TILE = 4096
FORM_RATIO = 2
#: Distinct words that a counting task holds before it hands its counts on.
HELD_WORDS = 400_000
#: Blocks up to this size are multiplied together, larger ones in strips of so many rows.
TOGETHER = 64
STRIP = 1024
SHORT = 64
#: Squared norms up to this are exact in 32-bit floats.
EXACT_FLOAT = 2000

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # LETTERS in UTF-8, lower-cased
#: Lower-cases A-Z and blanks the other ASCII characters that aren't letters.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _runs(text: bytes) -> Counter:
    """Lower-cased runs of letters of a UTF-8 text, with their counts."""
    words = Counter(text.translate(_PLAIN).split())
    if not text.isascii():
        for word in [w for w in words if not w.isascii()]:
            n = words.pop(word)
            for run in _RUN.findall(word):
                words[run] += n
    return words


def word_counts(
    df: DataFrame,
    min_chars: int = 5,
    min_count: int = 3,
    damage_every: int | None = None,
    row_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(word, n): words of at least ``min_chars`` code points and ``min_count`` occurrences.

    With ``damage_every`` a run whose crc32 h of UTF-8 ``<id>:<run>`` it divides loses
    the code point at h % length, which seeds known spelling errors.
    """
    ship(df.sparkSession)
    source = df.select(F.coalesce(F.col(row_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))

    def handed(counts: dict[bytes, int]) -> pa.RecordBatch:
        words = [w for w in counts if len(w) >= min_chars and (w.isascii() or len(w.decode()) >= min_chars)]
        n = pa.array([counts[w] for w in words], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), n], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc32 = zlib.crc32
        counts: Counter = Counter()
        for batch in batches:
            for own_id, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = _runs(value.as_py() or b"")
                if damage_every:
                    seed = crc32(f"{own_id}:".encode())
                    for word in [w for w in words if crc32(w, seed) % damage_every == 0]:
                        letters = word.decode()
                        at = crc32(word, seed) % len(letters)
                        n = words.pop(word)
                        # Counted apart from the text's own words, which must not be damaged again.
                        counts[(letters[:at] + letters[at + 1 :]).encode()] += n
                counts.update(words)
                if len(counts) > HELD_WORDS:
                    yield handed(counts)
                    counts.clear()
        yield handed(counts)

    spread = source.mapInArrow(run, "word string, n bigint")
    return spread.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _blocks(words: DataFrame, tile: int) -> DataFrame:
    """A row per word and unit of work: (key, low, high, tile, base, segment, word, n), units of one word left out."""
    size = F.char_length("word")

    def around(base, i):
        left, right = F.floor(base * i / SEGMENTS), base - F.floor(base * (i + 1) / SEGMENTS)
        kept = (F.substring(F.col("word"), F.lit(1), left.cast("int")), F.substring(F.col("word"), (size - right + 1).cast("int"), right.cast("int")))
        return F.struct(
            base.cast("int").alias("base"), F.lit(i).alias("segment"),
            F.xxhash64(base.cast("int"), F.lit(i), *kept).alias("key"),
        )

    spots = F.array(*(around(base, i) for base in (size, size - 1) for i in range(SEGMENTS)))
    rows = words.select("word", "n", F.explode(spots).alias("b")).select("word", "n", "b.*")
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    tiles = F.ceil(F.col("size") / tile)
    own = F.pmod(F.xxhash64("word"), tiles)
    units = F.transform(F.sequence(F.lit(0).cast("bigint"), tiles - 1), lambda u: F.struct(F.least(u, "tile").alias("low"), F.greatest(u, "tile").alias("high")))
    dealt = rows.join(sizes, "key").withColumn("tile", own).withColumn("unit", F.explode(units))
    return dealt.select("key", "unit.low", "unit.high", "tile", "base", "segment", "word", "n")


def _letter_rows(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Letter counts: a row per word, a column per letter that occurs."""
    letters, column = np.unique(data, return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    flat = np.bincount(row * len(letters) + column, minlength=len(sizes) * len(letters))
    kind = np.float32 if sizes.max(initial=0) <= EXACT_FLOAT else np.float64
    return flat.reshape(len(sizes), -1).astype(kind)


def _close(rows: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, squared distance) of rows i < j of one block that are at most two apart, by Gram products."""
    norms = (rows * rows).sum(axis=1)
    sizes = np.diff(edges)
    for size in np.unique(sizes[(sizes > 1) & (sizes <= TOGETHER)]):
        begin = edges[:-1][sizes == size]
        for at in range(0, len(begin), max(1, 2_000_000 // int(size * size))):
            take = begin[at : at + max(1, 2_000_000 // int(size * size)), None] + np.arange(size)
            block, norm = rows[take], norms[take]
            far = norm[:, :, None] + norm[:, None, :] - 2 * (block @ block.transpose(0, 2, 1))
            g, i, j = np.nonzero((far <= 2) & (np.arange(size)[:, None] < np.arange(size)))
            yield take[g, i], take[g, j], far[g, i, j]
    for first, last in zip(edges[:-1][sizes > TOGETHER], edges[1:][sizes > TOGETHER]):
        for at in range(first, last, STRIP):
            end = min(at + STRIP, last)
            far = norms[at:end, None] + norms[at:last] - 2 * (rows[at:end] @ rows[at:last].T)
            i, j = np.nonzero(far <= 2)
            later = j > i
            i, j = i[later], j[later]
            yield at + i, at + j, far[i, j]


def _first_difference(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Place of the first difference of rows that end in zeros."""
    return np.argmax(short != long, axis=1)


def _one_edit(short: bytes, long: bytes) -> int:
    """Place of the first difference if one edit leads from ``short`` to ``long``, else -1."""
    a, b = np.frombuffer(short, np.uint8), np.frombuffer(long, np.uint8)
    differ = np.flatnonzero(a != b[: len(a)])
    at = int(differ[0]) if len(differ) else len(a)
    same = len(differ) == 1 if len(a) == len(b) else np.array_equal(a[at:], b[at + 1 :])
    return at if same else -1


def _verified(words: list[bytes], padded: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Place of the first difference for pairs (i no longer than j) one edit apart, else -1."""
    at = np.full(len(i), -1)
    short = sizes[j] <= SHORT
    for low in range(0, len(i), 100_000):
        part = np.flatnonzero(short[low : low + 100_000]) + low
        if not len(part):
            continue
        a, b = padded[i[part]], padded[j[part]]
        place = _first_difference(a, b)
        same_size = sizes[i[part]] == sizes[j[part]]
        one = (a != b).sum(axis=1) == 1
        # The longer word without its letter at the first difference.
        moved = np.where(np.arange(a.shape[1] - 1) >= place[:, None], b[:, 1:], b[:, :-1])
        rest = (moved == a[:, :-1]).all(axis=1)
        at[part] = np.where(np.where(same_size, one, rest), place, -1)
    for k in np.flatnonzero(~short):
        at[k] = _one_edit(words[i[k]], words[j[k]])
    return at


def _near_in(part: pa.RecordBatch) -> pa.RecordBatch:
    """Near pairs, in both directions, of whole units of work."""
    key, low, high, tile, base, segment = (part.column(k).to_numpy() for k in range(6))
    words = [w.encode("latin-1") for w in part.column(6).to_pylist()]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    new = (np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0) | (np.diff(base) != 0) | (np.diff(segment) != 0)
    edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(words)]])
    rows = _letter_rows(np.frombuffer(b"".join(words), np.uint8), sizes)
    width = int(sizes[sizes <= SHORT].max(initial=0)) + 1
    padded = np.array([w[:width] for w in words], f"S{width}").view(np.uint8).reshape(len(words), width)
    found_i, found_j = [], []
    for i, j, far in _close(rows, edges):
        i, j = np.where(sizes[i] <= sizes[j], i, j), np.where(sizes[i] <= sizes[j], j, i)
        own = base[i]
        fits = (sizes[i] == own) & (far == np.where(sizes[j] == own, 2, 1)) & (sizes[j] <= own + 1)
        fits &= (low[i] == high[i]) | (tile[i] != tile[j])
        i, j = i[fits], j[fits]
        at = _verified(words, padded, sizes, i, j)
        own = base[i]
        place = at - (sizes[j] > own)  # an insertion at a stretch's end belongs to that stretch
        where = sum((place >= own * k // SEGMENTS).astype(int) for k in range(1, SEGMENTS))
        good = (at >= 0) & (where == segment[i])
        found_i.append(i[good])
        found_j.append(j[good])
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_i, found_j))
    one, other = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
    word, n = part.column(6), part.column(7)
    return pa.RecordBatch.from_arrays([word.take(one), word.take(other), n.take(other)], names=["word", "near", "near_n"])


def near_pairs(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, near, near_n) of every two near words, in both directions; ``words`` has distinct (word, n)."""
    ship(words.sparkSession)
    unit = ["key", "low", "high", "base", "segment"]
    dealt = _blocks(words, tile).repartition("key", "low", "high").sortWithinPartitions(*unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            last = [batch.column(k)[-1] for k in (0, 1, 2)]
            cut = batch.num_rows - 1
            while cut and all(batch.column(k)[cut - 1] == last[k] for k in range(3)):
                cut -= 1
            if cut:
                yield _near_in(batch.slice(0, cut))
            held = batch.slice(cut)
        if held is not None:
            yield _near_in(held)

    return dealt.mapInArrow(run, "word string, near string, near_n bigint")


def _ends(links: DataFrame) -> DataFrame:
    """(word, root): the last word reached by following (word, form) links."""
    now = settle(links.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further")
        moved = settle(moved)
        now = moved.select("word", "root")
        if moved.where("further is not null").isEmpty():
            return now


def variants(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of distinct (word, n)."""
    words = settle(words.select("word", "n"))
    best = near_pairs(words, tile).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    )
    enough = -F.col("best.less") >= FORM_RATIO * F.col("n")
    formed = settle(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = _ends(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
