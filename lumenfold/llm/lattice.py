"""Language-model scoring of whole texts by a subword lattice.

A text is lower-cased (A-Z only) and cut at ASCII white space; a word is scored
with a leading ``MARK``. The lattice of a word holds an edge for every vocabulary
piece that stands in it, and one per character as its UTF-8 bytes, so every word
has a path. An edge weighs what its piece weighs; the forward recursion in log
space sums over all segmentations, which gives the word's marginal probability.
No piece crosses a word's start, so a text's marginal is the product over its
words and the end symbol: ``score`` is its log10.

Weights: the public vocabulary has pieces in rank order (its file holds merge
ranks in place of log probabilities), so the existing scores are Zipf's law by
rank. They weight the segmentations of the training words; the expected piece
counts under them (forward and backward recursion), with the existing scores as
``PRIOR`` pseudo-counts a piece, are the learnt weights. The vocabulary stays as
it is. ``base_score`` is the word model: log10((c + 1) / (N + V + 1)) per token,
c the word's count, N all and V distinct training tokens, ends included.

Spread: a task cuts its rows in chunks of about ``CHUNK_BYTES`` of text; a chunk
has one row per distinct word with its count and one per document with coded
words, written once. Counts are summed per word, so a frequent word is as many
rows as there are chunks and never a group of its own; each distinct word is
scored once; its numbers go back to the chunks by joins on word and on chunk.
Nothing but the expected counts of the vocabulary's pieces reaches the driver.

Null and empty texts hold the end alone. With no training row the counts are 0
and the weights are the existing ones. Rows are scored one by one, so repeated
rows, null ids and ties need no rule; empty tables give empty ones. Words longer
than ``MAX_SHARED`` characters take a scalar form of the same recursions.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import remove_path, scratch_path, settle, ship
from lumenfold.llm.unigram import MARK, piece_scores

CHUNK_BYTES = 16_000_000
#: Words up to this length share array steps.
MAX_SHARED = 128
#: Cells (words x positions) of one array step.
STEP_CELLS = 200_000
#: Pseudo-counts of the existing scores, per piece on average.
PRIOR = 1.0
#: Share of the byte symbols, and of the end, in the existing scores.
BYTE_SHARE = 0.01
END_SHARE = 0.001
#: Stands behind the end of a word; no piece has it.
STOP = 0x110000
_CODE_BITS = 21


class Lattice:
    """Marginal probabilities and expected symbol counts of words.

    Symbols are the pieces in rank order, then 256 bytes, then the end.
    """

    def __init__(self, pieces: dict[str, float], log_weights: np.ndarray | None = None):
        self.pieces = list(pieces)
        n = len(self.pieces)
        if log_weights is None:
            ordinary = np.fromiter(pieces.values(), float, n) + math.log1p(-BYTE_SHARE - END_SHARE)
            log_weights = np.concatenate([ordinary, np.full(256, math.log(BYTE_SHARE / 256)), [math.log(END_SHARE)]])
        self.weights = log_weights
        self.bytes_at = n
        self.end = float(log_weights[-1])
        self.longest = max(map(len, self.pieces), default=1)
        self.children: dict[int, int] = {}
        piece_at = [-1]
        for number, piece in enumerate(self.pieces):
            node = 0
            for char in piece:
                key = node << _CODE_BITS | ord(char)
                child = self.children.get(key)
                if child is None:
                    child = self.children[key] = len(piece_at)
                    piece_at.append(-1)
                node = child
            piece_at[node] = number
        self.piece_at = np.array(piece_at)
        self.keys = np.array(sorted(self.children), np.int64)
        self.child = np.array([self.children[k] for k in self.keys.tolist()], np.int64)

    def _char_bytes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log weight of each code as bytes, matrix of byte counts per code)."""
        counts = np.zeros((len(codes), 256))
        for i, code in enumerate(codes.tolist()):
            for byte in chr(code).encode() if code < STOP else b"":
                counts[i, byte] += 1
        return counts @ self.weights[self.bytes_at : self.bytes_at + 256], counts

    def _next(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = node << _CODE_BITS | code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.child[at], -1)

    def _edges(self, codes: np.ndarray, sizes: np.ndarray) -> list[list[tuple[np.ndarray, int, np.ndarray]]]:
        """For each position the (rows, size, pieces) of the edges that begin there; rows are sorted by falling size."""
        out = []
        for i in range(codes.shape[1]):
            here = []
            rows = np.arange(np.searchsorted(-sizes, -i, "left"))
            node = np.zeros(len(rows), np.int64)
            for size in range(1, min(self.longest, codes.shape[1] - i) + 1):
                node = self._next(node, codes[rows, i + size - 1])
                alive = node >= 0
                rows, node = rows[alive], node[alive]
                if not len(rows):
                    break
                piece = self.piece_at[node]
                hit = piece >= 0
                if hit.any():
                    here.append((rows[hit], size, piece[hit]))
            out.append(here)
        return out

    def _together(self, words: list[str], times: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
        """Log probabilities of words sorted by falling length; adds to ``expected`` the symbol counts of ``times`` each."""
        sizes = np.array([len(w) for w in words])
        codes = np.full((len(words), sizes[0]), STOP, np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        codes[np.arange(sizes[0]) < sizes[:, None]] = flat
        chars, place = np.unique(codes, return_inverse=True)
        place = place.reshape(codes.shape)
        as_bytes, byte_counts = self._char_bytes(chars)
        edges = self._edges(codes, sizes)
        forward = np.full((len(words), sizes[0] + 1), -np.inf)
        forward[:, 0] = 0
        for i, here in enumerate(edges):
            k = np.searchsorted(-sizes, -i, "left")
            forward[:k, i + 1] = np.logaddexp(forward[:k, i + 1], forward[:k, i] + as_bytes[place[:k, i]])
            for rows, size, piece in here:
                forward[rows, i + size] = np.logaddexp(forward[rows, i + size], forward[rows, i] + self.weights[piece])
        every = np.arange(len(words))
        total = forward[every, sizes]
        if expected is None:
            return total
        backward = np.full(forward.shape, -np.inf)
        backward[every, sizes] = 0
        char_times = np.zeros(len(chars))
        for i in range(len(edges) - 1, -1, -1):
            k = np.searchsorted(-sizes, -i, "left")
            at = place[:k, i]
            through = as_bytes[at] + backward[:k, i + 1]
            backward[:k, i] = through
            share = np.exp(forward[:k, i] + through - total[:k]) * times[:k]
            char_times += np.bincount(at, share, len(chars))
            for rows, size, piece in edges[i]:
                through = self.weights[piece] + backward[rows, i + size]
                backward[rows, i] = np.logaddexp(backward[rows, i], through)
                share = np.exp(forward[rows, i] + through - total[rows]) * times[rows]
                expected += np.bincount(piece, share, len(expected))
        expected[self.bytes_at : self.bytes_at + 256] += char_times @ byte_counts
        return total

    def _alone(self, word: str, times: float, expected: np.ndarray | None) -> float:
        """The same for one long word, position by position."""
        n = len(word)
        chars = sorted(set(word))
        as_bytes, byte_counts = self._char_bytes(np.array([ord(c) for c in chars]))
        number = {c: i for i, c in enumerate(chars)}
        children, piece_at, weights = self.children, self.piece_at, self.weights
        forward = array("d", [-math.inf]) * (n + 1)
        forward[0] = 0.0
        starts, sizes, symbols = array("q"), array("q"), array("q")  # a symbol below 0 is a character as bytes
        add = lambda a, b: a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))

        def weight(symbol: int) -> float:
            return weights[symbol] if symbol >= 0 else as_bytes[-symbol - 1]

        for i in range(n):
            node = 0
            found = [(1, -number[word[i]] - 1)]
            for end in range(i, min(i + self.longest, n)):
                node = children.get(node << _CODE_BITS | ord(word[end]))
                if node is None:
                    break
                if piece_at[node] >= 0:
                    found.append((end + 1 - i, int(piece_at[node])))
            for size, symbol in found:
                forward[i + size] = add(forward[i + size], forward[i] + weight(symbol))
                starts.append(i)
                sizes.append(size)
                symbols.append(symbol)
        if expected is not None:
            backward = array("d", [-math.inf]) * (n + 1)
            backward[n] = 0.0
            for i, size, symbol in zip(reversed(starts), reversed(sizes), reversed(symbols)):
                through = weight(symbol) + backward[i + size]
                backward[i] = add(backward[i], through)
                share = math.exp(forward[i] + through - forward[n]) * times
                if symbol >= 0:
                    expected[symbol] += share
                else:
                    expected[self.bytes_at : self.bytes_at + 256] += byte_counts[-symbol - 1] * share
        return forward[n]

    def score(self, words: list[str], times: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Log marginal probability of each word (with its mark); adds expected symbol counts if asked."""
        out = np.empty(len(words))
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        at = 0
        while at < len(order):
            size = len(words[order[at]]) + 1
            if size > MAX_SHARED:
                i = order[at]
                out[i] = self._alone(MARK + words[i], 1.0 if times is None else float(times[i]), expected)
                at += 1
                continue
            part = order[at : at + max(1, STEP_CELLS // size)]
            own = None if times is None else times[part]
            out[part] = self._together([MARK + words[i] for i in part], own, expected)
            at += len(part)
        return out


_READY: dict[bytes, Lattice] = {}


def _lattice(model_file: bytes, weights: bytes | None) -> Lattice:
    """The lattice of a vocabulary file and weights, kept per worker (the two in use)."""
    key = hashlib.sha256(model_file + b"/" + (weights or b"")).digest()
    if key not in _READY:
        if len(_READY) > 1:
            _READY.clear()
        _READY[key] = Lattice(piece_scores(model_file), None if weights is None else np.frombuffer(weights))
    return _READY[key]


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in the narrowest width that holds them; the width follows from the length."""
    top = int(values.max(initial=0))
    return values.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {0: np.uint8, 1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // n if n else 0])


def _chunks(df: DataFrame, train: str, text: str, keep: tuple[str, ...], chunk_bytes: int) -> DataFrame:
    """Rows of two kinds per chunk: (word, place, n in training rows) and (document with coded words)."""
    ship(df.sparkSession)
    source = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(train), F.col(text))
    kept_places = list(range(len(keep)))
    kinds = [f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(source.schema.fields[: len(keep)])]
    fields = ["chunk bigint", "word string", "place int", "n bigint", "train boolean", "words int", "tokens bigint", "codes binary", "times binary"]
    schema = ", ".join([*kinds, *fields])
    names = [x.split()[0] for x in [*kinds, *fields]]

    def rows(chunk: int, words: dict[bytes, int], docs: list[tuple], kept: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(words), np.int64)
        for is_train, codes, times in docs:
            if is_train:
                count[codes] += times  # codes of one document are distinct
        none = [pa.nulls(len(words), c.type) for c in kept.columns]
        nulls = (pa.nulls(len(words), t) for t in (pa.bool_(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))
        own = [pa.array(np.full(len(words), chunk)), pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(np.arange(len(words), dtype=np.int32)), pa.array(count)]
        yield from pa.table([*none, *own, *nulls], names).to_batches()
        n = len(docs)
        nulls = [pa.nulls(n, t) for t in (pa.string(), pa.int32(), pa.int64())]
        coded = [
            pa.array([d[0] for d in docs], pa.bool_()), pa.array([len(d[1]) for d in docs], pa.int32()),
            pa.array([int(d[2].sum()) for d in docs], pa.int64()),
            pa.array([_packed(np.diff(d[1], prepend=0)) for d in docs], pa.binary()), pa.array([_packed(d[2]) for d in docs], pa.binary()),
        ]
        yield from pa.table([*kept.columns, pa.array(np.full(n, chunk)), *nulls, *coded], names).to_batches(max_chunksize=1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        words: dict[bytes, int] = defaultdict()
        words.default_factory = words.__len__
        docs, kept, size = [], [], 0
        for batch in batches:
            start = 0
            is_train = batch.column(len(keep)).to_pylist()
            for i, text in enumerate(batch.column(len(keep) + 1).cast(pa.binary())):
                raw = (text.as_py() or b"").lower().split()  # bytes: A-Z and ASCII white space alone
                codes, times = np.unique(np.fromiter(map(words.__getitem__, raw), np.int64, len(raw)), return_counts=True)
                docs.append((bool(is_train[i]), codes, times))
                size += sum(map(len, raw)) + len(raw)
                if size >= chunk_bytes:
                    kept.append(batch.slice(start, i + 1 - start).select(kept_places))
                    yield from rows(chunk, words, docs, pa.Table.from_batches(kept).combine_chunks())
                    words.clear()
                    chunk, docs, kept, size, start = chunk + 1, [], [], 0, i + 1
            kept.append(batch.slice(start).select(kept_places))
        if docs:
            yield from rows(chunk, words, docs, pa.Table.from_batches(kept).combine_chunks())

    return source.mapInArrow(run, schema)


def _expected(counts: DataFrame, model) -> DataFrame:
    """(symbol, times) expected in the training words under the existing weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model.value, None)
        expected = np.zeros(len(lattice.weights))
        for batch in batches:
            lattice.score(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float), expected)
        symbols = np.flatnonzero(expected)
        yield pa.RecordBatch.from_arrays([pa.array(symbols, pa.int32()), pa.array(expected[symbols])], names=["symbol", "times"])

    spread = counts.where("c > 0").mapInArrow(run, "symbol int, times double")
    return spread.groupBy("symbol").agg(F.sum("times").alias("times"))


def learnt_weights(existing: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Log weights from expected counts, with ``PRIOR`` pseudo-counts a symbol dealt by the existing weights."""
    counts = expected + PRIOR * len(existing) * np.exp(existing)
    return np.log(counts) - math.log(counts.sum())


def score_texts(
    df: DataFrame,
    path: str,
    train: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``train`` names a boolean column: rows that it holds true are learnt from.
    ``path`` is a sentencepiece model file.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    with open(path, "rb") as fh:
        model = sc.broadcast(fh.read())  # one file of fixed size
    kept_types = [df.schema[c].dataType.simpleString() for c in keep]
    staged_at = scratch_path(spark, "lattice-chunks")
    _chunks(df, train, text, keep, chunk_bytes).write.parquet(staged_at)
    words = spark.read.parquet(staged_at).where("word is not null").select("chunk", "place", "word", "n")
    staged = spark.read.parquet(staged_at).where("word is null")
    docs = staged.select(*(f"k{i}" for i in range(len(keep))), "chunk", "words", "tokens", "codes", "times")
    counts = settle(words.groupBy("word").agg(F.sum("n").alias("c")))
    ends = staged.agg(F.count_if(F.col("train"))).first()[0]
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    tokens, distinct = tokens + ends, distinct + (ends > 0)

    existing = Lattice(piece_scores(model.value)).weights
    expected = np.zeros(len(existing))
    # One row per symbol of the vocabulary at most.
    for symbol, times in _expected(counts, model).collect():
        expected[symbol] = times
    expected[-1] = ends
    learnt = learnt_weights(existing, expected) if ends else existing
    weights = sc.broadcast(learnt.tobytes())

    def word_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model.value, weights.value)
        for batch in batches:
            scored = pa.array(lattice.score(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, scored], names=["word", "c", "lp"])

    scored = counts.mapInArrow(word_scores, "word string, c bigint, lp double")
    numbers = words.select("chunk", "place", "word").join(scored, "word").select("chunk", "place", "c", "lp")
    mass, end_lp = tokens + distinct + 1, float(learnt[-1])
    names = [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def text_scores(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right["place"].to_numpy()
        count, lp = np.zeros(len(place)), np.zeros(len(place))
        count[place], lp[place] = right["c"].to_numpy(), right["lp"].to_numpy()
        base = np.log10((count + 1) / mass)
        out = np.zeros((3, left.num_rows))
        packed = zip(left["words"].to_pylist(), left["codes"].to_pylist(), left["times"].to_pylist())
        for i, (n, codes, times) in enumerate(packed):
            codes = np.cumsum(_unpacked(codes, n), dtype=np.int64)
            times = _unpacked(times, n).astype(float)
            out[:, i] = times[count[codes] > 0].sum(), times @ base[codes], times @ lp[codes]
        n = left.num_rows
        columns = [
            pc.add(left["tokens"], 1), pa.array(out[0].astype(np.int64) + int(ends > 0)), pa.array(np.full(n, tokens)),
            pa.array(out[1] + math.log10((ends + 1) / mass)), pa.array((out[2] + end_lp) / math.log(10)),
        ]
        return pa.table([*(left[f"k{i}"] for i in range(len(keep))), *columns], names=names)

    schema = ", ".join([
        *(f"`{c}` {t}" for c, t in zip(keep, kept_types)),
        "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    ])
    result = settle(docs.groupBy("chunk").cogroup(numbers.groupBy("chunk")).applyInArrow(text_scores, schema))
    remove_path(spark, staged_at)
    return result
