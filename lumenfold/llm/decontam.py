"""Benchmark decontamination by SimHash windows.

Texts are lower-case words of letters and digits, and their shingles are five
words long (the whole text, if it has fewer). For every benchmark item, windows with
as many words as the item slide over each document by one word; a document that is
shorter than the item is one window. A window's fingerprint (64 bits, votes of
its shingles with their weights) is looked up among the items of that size: the
fingerprint is dealt into eight blocks of eight bits, and an item within
``RADIUS`` differing bits agrees with it to ``RADIUS // 8`` bits in at least one
block, so block tables find every item within the radius. What they find is
checked by its bits, and then by the exact similarity of the weighted shingles
(weights are numbers of occurrences; sum of the lesser over sum of the greater
weights). ``SIMILARITY`` or more is a match.

A window without any shingle of an item of its size has similarity 0 to all of
them; such windows are passed over, which loses nothing.

The benchmark goes to the workers in blocks of ``BLOCK_CHARS`` characters, so
what is broadcast is bounded; every block is one pass over the documents.

Items of fewer than five words match equal words only. Null and empty texts never
match. Repeated rows match alike; equal items (id and text) count
once. Of several windows of a document that match an item, the most similar, then
the first, is reported.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import reduce
from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import filter_texts, map_texts

SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits of fingerprints that are looked at; similar windows differ by 9 of 64 bits on average.
RADIUS = 24
BLOCKS = 8
BLOCK_CHARS = 16_000_000

_WORDS = re.compile(r"[^\W_]+")
#: Odd multipliers that make one number of five word numbers.
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def split_words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def shingles(words: list[str]) -> list[str]:
    if 0 < len(words) < SHINGLE:
        return [" ".join(words)]
    return [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def _votes(grams: list[str]) -> np.ndarray:
    """+1 or -1 per shingle and bit."""
    hashes = np.array([xxhash.xxh64_intdigest(g) for g in grams], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints (uint64) of rows of 64 sums."""
    return np.ascontiguousarray(np.packbits(sums > 0, axis=1, bitorder="little")).view("<u8").ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Sum of the lesser over the sum of the greater weights."""
    shared = sum(min(n, b[g]) for g, n in a.items() if g in b)
    return shared / (a.total() + b.total() - shared)


class _Size:
    """Items of one size in words, with the block tables of their fingerprints."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.ids = [i for i, _ in items]
        grams = [shingles(w) for _, w in items]
        self.weights = [Counter(g) for g in grams]
        self.prints = np.array([_pack(_votes(g).sum(axis=0)[None])[0] for g in grams], np.uint64)
        parts = self.prints[:, None].view(np.uint8).reshape(len(items), BLOCKS)
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= RADIUS // BLOCKS
        #: By block and byte: which items are near in that block.
        self.tables = [near[:, parts[:, b]] for b in range(BLOCKS)]

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) places of all fingerprints within the radius."""
        parts = prints[:, None].view(np.uint8).reshape(len(prints), BLOCKS)
        found = reduce(np.logical_or, (t[parts[:, b]] for b, t in enumerate(self.tables)))
        window, item = np.nonzero(found)
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[close], item[close]


class Benchmark:
    """Index over items (id, text)."""

    def __init__(self, items: list[tuple[int, str]]):
        by_size: dict[int, list[tuple[int, list[str]]]] = defaultdict(list)
        self.numbers: dict[str, int] = {}
        codes: dict[int, list[np.ndarray]] = defaultdict(list)
        #: By size: the items of fewer than five words.
        self.short: dict[int, dict[tuple[str, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        for key, text in sorted(set(items), key=str):
            words = split_words(text)
            if len(words) < SHINGLE:
                if words:
                    self.short[len(words)][tuple(words)].append(key)
                continue
            by_size[len(words)].append((key, words))
            codes[len(words)].append(self._codes(np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words])))
        self.sizes = {n: _Size(own) for n, own in by_size.items()}
        self.codes = {n: np.unique(np.concatenate(c)) for n, c in codes.items()}
        self.all_codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.codes.values()]))

    @staticmethod
    def _codes(numbers: np.ndarray) -> np.ndarray:
        n = len(numbers) - SHINGLE + 1
        values = numbers.astype(np.uint64)
        return sum(values[i : i + n] * _MIX[i] for i in range(SHINGLE)) if n > 0 else np.zeros(0, np.uint64)

    def hits(self, texts: list[list[str]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(text, shingle places, codes) for texts that share a shingle with an item."""
        sizes = np.array([len(t) for t in texts], np.int64)
        edges = np.append(0, np.cumsum(sizes))
        flat = np.fromiter((x for t in texts for x in map(self.numbers.get, t, repeat(-1))), np.int64, int(edges[-1]))
        if len(flat) < SHINGLE or not len(self.all_codes):
            return []
        known = np.append(0, np.cumsum(flat >= 0))
        places = np.flatnonzero(known[SHINGLE:] - known[:-SHINGLE] == SHINGLE)
        owner = np.searchsorted(edges, places, "right") - 1
        places = places[places + SHINGLE <= edges[owner + 1]]
        codes = sum(flat[places + i].astype(np.uint64) * _MIX[i] for i in range(SHINGLE))
        at = np.minimum(np.searchsorted(self.all_codes, codes), len(self.all_codes) - 1)
        real = self.all_codes[at] == codes
        places, codes = places[real], codes[real]
        owner = np.searchsorted(edges, places, "right") - 1
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        return [
            (int(owner[a]), places[a:b] - edges[owner[a]], codes[a:b])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(owner)])
        ]

    def matches(self, words: list[str], places: np.ndarray, codes: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of one text's best window per matched item."""
        best: dict[int, tuple[float, int, int]] = {}
        for n, items in self.short.items():
            for at, gram in enumerate(zip(*(words[i:] for i in range(n)))):
                for key in items.get(gram, ()):
                    if key not in best or at < best[key][1]:
                        best[key] = (1.0, at, n)
        for n, size in self.sizes.items() if len(places) else ():
            width = min(n, len(words))
            grams = width - SHINGLE + 1
            if grams / (n - SHINGLE + 1) < SIMILARITY:
                continue
            own = places[np.isin(codes, self.codes[n])]
            if not len(own):
                continue
            last = len(words) - width
            # Windows that hold one of these shingles, as stretches of window starts.
            lows, highs = np.maximum(own - grams + 1, 0), np.minimum(own, last)
            fresh = np.flatnonzero(np.append(True, lows[1:] > highs[:-1] + 1))
            for a, b in zip(fresh.tolist(), [*fresh[1:].tolist(), len(own)]):
                low, high = int(lows[a]), int(highs[b - 1])
                if high < low:
                    continue
                part = shingles(words[low : high + width])
                sums = np.zeros((len(part) + 1, 64), np.int32)
                np.cumsum(_votes(part), axis=0, out=sums[1:])
                windows, items = size.candidates(_pack(sums[grams:] - sums[:-grams]))
                for w, i in zip(windows.tolist(), items.tolist()):
                    s = similarity(Counter(part[w : w + grams]), size.weights[i])
                    key = size.ids[i]
                    if s >= SIMILARITY and (key not in best or (-s, low + w) < (-best[key][0], best[key][1])):
                        best[key] = (s, low + w, width)
        return [(key, *found) for key, found in best.items()]

    def found(self, texts: list[list[str]]) -> list[list[tuple[int, float, int, int]]]:
        """The matches of each text."""
        shared = {at: (places, codes) for at, places, codes in self.hits(texts)}
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        return [self.matches(t, *shared.get(i, none)) if i in shared or self.short else [] for i, t in enumerate(texts)]


def _blocks(benchmark: DataFrame, block_chars: int):
    """Lists of (item_id, text) of bounded size."""
    block, chars = [], 0
    rows = benchmark.where("text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        if block and chars + len(row.text) > block_chars:
            yield block
            block, chars = [], 0
        block.append((row.item_id, row.text))
        chars += len(row.text)
    yield block


def find_matches(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): a row per document and matched item."""

    def one(block) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make():
            index = Benchmark(shared.value)

            def step(texts):
                names = ("item_id", "similarity", "start_word", "n_words")
                found = index.found([split_words(t) for t in texts])
                return {"found": [[dict(zip(names, m)) for m in own] for own in found]}

            return step

        kind = "found array<struct<item_id:bigint,similarity:double,start_word:int,n_words:int>>"
        return map_texts(docs, kind, make, keep=("doc_id",)).select("doc_id", F.inline("found"))

    found = reduce(DataFrame.union, (one(b) for b in _blocks(benchmark, block_chars)))
    return found


def without_matches(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns."""

    def one(rows: DataFrame, block) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make():
            index = Benchmark(shared.value)

            def step(texts):
                return [not own for own in index.found([split_words(t) for t in texts])]

            return step

        return filter_texts(rows, make)

    return reduce(one, _blocks(benchmark, block_chars), docs)
