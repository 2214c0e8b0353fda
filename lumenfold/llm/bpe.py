"""Byte-level BPE encoding and decoding.

Pre-tokenisation works on whole arrays and without a regex engine. Every code
point becomes a symbol (letter, number, space, other white space, apostrophe
before a contraction, anything else); each symbol is a function from scanner
state to scanner state, functions compose associatively, and their finite
closure is a lookup table. A blocked scan composes the symbols of each block,
carries the state over the block results and then replays all blocks side by
side, which gives the state before every character and so the slice starts.
The slices are byte ranges of one UTF-8 buffer; distinct slices are merged once
by rank and kept in a bounded cache. Token byte offsets are kept, so decoding
can return any part of a text.

Null and empty texts give no tokens and decode to the empty text. Repeated rows
give repeated results. Columns other than those asked for never enter the plan.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import map_texts, ship

# Scanner symbols.
LETTER, NUMBER, OTHER, APOS2, APOS3, SPACE, WHITE, END = range(8)
# Scanner states: what the character before belongs to.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, TAIL1, TAIL2 = range(7)

#: A code point that no text has; it ends a text in the joined array.
STOP = 0x110000

#: Pieces kept per worker before the cache starts anew.
CACHE_PIECES = 400_000

#: Slices up to this length are merged by scanning a short list, longer ones with a heap.
SHORT_BYTES = 64
NO_RANK = 1 << 62

#: Long texts are cut (before a white-space run, where no slice can cross) at about this length.
SEGMENT_CHARS = 1_000_000


def _next_state(state: int, symbol: int) -> int:
    if state == TAIL2:
        return TAIL1
    if state == TAIL1:
        return FRESH
    if symbol == LETTER:
        return IN_LETTERS
    if symbol == NUMBER:
        return IN_NUMBERS
    if symbol == SPACE:
        return AFTER_SPACE
    if symbol in (WHITE, END):
        return FRESH
    if symbol == OTHER or state in (IN_OTHER, AFTER_SPACE):
        return IN_OTHER
    return TAIL1 if symbol == APOS2 else TAIL2


def _closure() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the symbol functions: table, symbol ids, and each as a state map."""
    symbols = [tuple(_next_state(s, y) for s in range(7)) for y in range(8)]
    known = {f: i for i, f in enumerate(dict.fromkeys(symbols))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in symbols:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    maps = list(known)
    size = len(maps)
    # Every element is a chain of symbols, so products of elements stay inside.
    table = np.array([[known[tuple(g[s] for s in f)] for g in maps] for f in maps], np.int32)
    return table.reshape(size * size), np.array([known[f] for f in symbols], np.int32), np.array(maps, np.uint8)


COMPOSE, SYMBOL_FUNCTION, FUNCTION_STATES = _closure()
STEP = np.array([[_next_state(s, y) for y in range(8)] for s in range(7)], np.uint8).reshape(56)
BLOCK = 256


def states_before(symbols: np.ndarray) -> np.ndarray:
    """Scanner state before each symbol (the first is FRESH)."""
    n = len(symbols)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, END, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    functions = SYMBOL_FUNCTION.take(columns)
    size = len(FUNCTION_STATES)
    block = functions[0]
    for j in range(1, BLOCK):
        block = COMPOSE.take(block * size + functions[j])
    states, carried = FUNCTION_STATES.tolist(), []
    state = FRESH
    for f in block.tolist():
        carried.append(state)
        state = states[f][state]
    current = np.array(carried, np.uint8)
    before = np.empty_like(columns)
    for j in range(BLOCK):
        before[j] = current
        current = STEP.take(current * 8 + columns[j])
    return np.ascontiguousarray(before.T).reshape(-1)[:n]


_CLASSES: np.ndarray | None = None


def code_point_classes() -> np.ndarray:
    """Symbol of every code point, by the Unicode tables of the tokenizer library itself."""
    global _CLASSES
    if _CLASSES is None:
        import tiktoken

        single = {bytes([i]): i for i in range(256)}
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        classes = np.full(STOP + 1, OTHER, np.uint8)
        for pattern, symbol in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
            probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
            found = bytes(probe.encode_ordinary(everything)).decode("utf-8")
            classes[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = symbol
        classes[0x20] = SPACE
        classes[STOP] = END
        _CLASSES = classes
    return _CLASSES


def slice_starts(points: np.ndarray) -> np.ndarray:
    """Indices where a slice starts in ``points`` (texts, each ended by STOP); STOPs are starts too."""
    symbols = code_point_classes().take(points)
    # An apostrophe before s, t, m, d or re, ve, ll may be a contraction.
    apostrophes = np.flatnonzero(points == 0x27)
    if len(apostrophes):
        tail = np.append(points, [STOP, STOP])
        one, two = tail[apostrophes + 1], tail[apostrophes + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbols[apostrophes[short]] = APOS2
        symbols[apostrophes[long & ~short]] = APOS3
    before = states_before(symbols)
    white = (symbols == SPACE) | (symbols == WHITE)
    end = symbols == END
    after_white = np.empty_like(white)
    after_white[0], after_white[1:] = False, white[:-1]
    before_text = np.empty_like(white)
    before_text[-1], before_text[:-1] = False, ~(white | end)[1:]
    # The last of a white-space run before text starts a slice (and a space joins that text).
    starts = white & (~after_white | before_text)
    free = (before != TAIL1) & (before != TAIL2) & (before != AFTER_SPACE)
    starts |= (symbols == LETTER) & free & (before != IN_LETTERS)
    starts |= (symbols == NUMBER) & free & (before != IN_NUMBERS)
    starts |= (symbols >= OTHER) & (symbols <= APOS3) & free & (before != IN_OTHER)
    return np.flatnonzero(starts | end)


_CUT = re.compile(r"(?<=\S)[ \n]")


def segments(text: str) -> list[str]:
    """Cut a long text before white-space runs; slices are the same as in the whole."""
    if len(text) <= SEGMENT_CHARS:
        return [text]
    out, start = [], 0
    while len(text) - start > SEGMENT_CHARS:
        cut = _CUT.search(text, start + SEGMENT_CHARS)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


class ByteBpe:
    """Encoder and decoder for a rank file's bytes (``base64 rank`` per line)."""

    def __init__(self, rank_file: bytes):
        pairs = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.size = max(self.ranks.values(), default=-1) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self._renew()

    def _renew(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = array("I")
        self.first = array("q", [0])

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: join the adjacent pair of lowest rank, leftmost first, while any has a rank."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n <= SHORT_BYTES:
            cut = list(range(n + 1))
            pair = [ranks.get(piece[i : i + 2], NO_RANK) for i in range(n - 1)]
            while pair and (low := min(pair)) != NO_RANK:
                i = pair.index(low)
                del cut[i + 1], pair[i]
                if i:
                    pair[i - 1] = ranks.get(piece[cut[i - 1] : cut[i + 1]], NO_RANK)
                if i < len(pair):
                    pair[i] = ranks.get(piece[cut[i] : cut[i + 2]], NO_RANK)
            return [ranks[piece[a:b]] for a, b in zip(cut, cut[1:])]
        # Long slices: a heap of pairs, so the work stays near n log n.
        follow, prior, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = follow[i] if end[i] else n
            # Stale when either part was merged since: the pair no longer spans the same bytes.
            if not end[i] or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            follow[i] = k = follow[j]
            if k < n:
                prior[k] = i
                r = ranks.get(piece[i : end[k]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            h = prior[i]
            if h >= 0:
                r = ranks.get(piece[h:stop])
                if r is not None:
                    heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = follow[i]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, first id of each text and the total)."""
        parts, owner = [], []
        for d, text in enumerate(texts):
            for part in segments(text):
                parts.append(part)
                owner.append(d)
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        stop = np.array([STOP], np.uint32).tobytes()
        points = np.frombuffer(stop.join([p.encode("utf-32-le") for p in parts]) + stop, np.uint32)
        data = "".join(parts).encode("utf-8")
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        width[points == STOP] = 0
        offset = np.cumsum(width) - width
        starts = slice_starts(points)
        real = points[starts] != STOP
        bounds = np.append(offset[starts], len(data))
        lows, highs = bounds[:-1][real].tolist(), bounds[1:][real].tolist()
        pieces = [data[a:b] for a, b in zip(lows, highs)]
        if len(self.known) > CACHE_PIECES:
            self._renew()
        known, flat, first = self.known, self.flat, self.first
        for piece in set(pieces).difference(known):
            known[piece] = len(first) - 1
            flat.extend(self.merge(piece))
            first.append(len(flat))
        index = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        edges, values = np.array(first, np.int64), np.array(flat, np.uint32)
        begin, count = edges[index], edges[index + 1] - edges[index]
        before = np.cumsum(count) - count
        ids = values[np.repeat(begin - before, count) + np.arange(int(count.sum()))] if len(index) else values[:0]
        # Slices before each part's end, then ids before each text.
        slices = np.searchsorted(np.flatnonzero(real), np.flatnonzero(~real))
        after = np.append(before, len(ids))[slices]
        ends = np.zeros(len(texts) + 1, np.int64)
        ends[np.array(owner) + 1] = after  # the last part of a text wins
        return ids, np.maximum.accumulate(ends)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Start byte of each token of one text."""
        size = self.lengths[ids]
        return np.cumsum(size) - size

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_READY: dict[bytes, ByteBpe] = {}


def coder(rank_file: bytes) -> ByteBpe:
    """The worker's coder for this vocabulary, built once."""
    key = hashlib.sha256(rank_file).digest()
    if key not in _READY:
        _READY[key] = ByteBpe(rank_file)
    return _READY[key]


def _shared(df: DataFrame, path: str):
    """The vocabulary (a file of fixed size, under a megabyte) for all executors."""
    with open(path, "rb") as fh:
        return df.sparkSession.sparkContext.broadcast(fh.read())


def bpe_encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` array<int> and ``offsets`` array<int> (start byte of each token)."""
    shared = _shared(df, path)

    def make():
        bpe = coder(shared.value)

        def step(texts):
            ids, edges = bpe.encode([t or "" for t in texts])
            size = bpe.lengths[ids]
            total = np.append(0, np.cumsum(size))
            starts = total[:-1] - np.repeat(total[edges[:-1]], np.diff(edges))
            lists = lambda v: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(v, pa.int32()))
            return {"ids": lists(ids.astype(np.int32)), "offsets": lists(starts.astype(np.int32))}

        return step

    return map_texts(df, "ids array<int>, offsets array<int>", make, text, keep)


def bpe_decode(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded`` (binary) from the ``ids`` column; null ids give null."""
    shared = _shared(df, path)
    ship(df.sparkSession)
    source = df.select(*keep, F.col("ids").alias("_ids"))
    fields = source.select(*keep).schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "decoded binary"])

    def run(batches):
        bpe = coder(shared.value)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            decoded = [None if x is None else b"".join(map(bpe.tokens.__getitem__, x)) for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(decoded, pa.binary())],
                names=[*keep, "decoded"],
            )

    return source.mapInArrow(run, schema)


def bpe_digests(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode and decode in one pass: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    The ids are digested as little-endian unsigned 32-bit integers and the
    digest of the decoded bytes comes from decoding those ids, so a lossless
    round trip shows as sha256 of the text.
    """
    shared = _shared(df, path)

    def make():
        bpe = coder(shared.value)

        def step(texts):
            ids, edges = bpe.encode([t or "" for t in texts])
            ids = ids.astype("<u4")
            spans = [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            return {
                "n_tokens": np.diff(edges),
                "ids_sha256": [hashlib.sha256(s.tobytes()).hexdigest() for s in spans],
                "decoded_sha256": [hashlib.sha256(bpe.decode(s)).hexdigest() for s in spans],
            }

        return step

    return map_texts(df, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make, text, keep)
