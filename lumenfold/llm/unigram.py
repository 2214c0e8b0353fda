"""Token counts of a unigram segmentation, shared through a trie.

A text is cut at white space; every word with a leading ``MARK`` is a pre-token.
The vocabulary's pieces have log probabilities by rank (Zipf), and a pre-token's
tokens are those of its most probable segmentation (of equally probable ones the
shortest). A character that no piece covers costs ``FALLBACK`` beyond the least
probable piece and counts as its UTF-8 bytes.

Pre-tokens are inserted in a trie. The forward score of a node (the best
log probability of any segmentation of the prefix that it stands for) and its
token count depend on its ancestors only, so they are computed once, when the
node is made, and serve all pre-tokens with that prefix. A terminal's count is
the pre-token's.

Null and empty texts have no tokens. Tries are kept per worker and start anew at
``MAX_NODES`` nodes; pre-tokens of over ``MAX_SHARED`` characters are scored on
a path of their own, so memory stays bounded. Repeated rows count alike.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame

from lumenfold.llm.common import map_texts

MARK = "▁"
FALLBACK = 10.0
MAX_NODES = 1_000_000
MAX_SHARED = 64
#: Shift of the Zipf law: a piece of rank r has a weight of 1 / (r + SHIFT).
SHIFT = 2.7


def piece_scores(model_file: bytes) -> dict[str, float]:
    """Log probability of each ordinary piece of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=model_file)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)]
    total = math.log(sum(1 / (r + SHIFT) for r in range(len(pieces))))
    scores: dict[str, float] = {}
    for r, piece in enumerate(pieces):
        scores.setdefault(piece, -math.log(r + SHIFT) - total)
    return scores


class TokenTrie:
    """Counts tokens of pre-tokens by a vocabulary of log probabilities."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - FALLBACK
        self._renew()

    def _renew(self) -> None:
        #: node * 0x110000 + code point -> child; forward score and token count by node.
        self.children: dict[int, int] = {}
        self.score = [0.0]
        self.tokens = [0]
        self.known: dict[str, int] = {}

    def _forward(self, text: str, end: int, score: list[float], tokens: list[int], path: list[int]) -> tuple[float, int]:
        """Best (score, tokens) of text[:end], given those of all shorter prefixes along ``path``."""
        char = text[end - 1]
        node = path[-1]
        best, count = score[node] + self.unknown, tokens[node] + len(char.encode("utf-8", "surrogatepass"))
        get = self.scores.get
        for size in range(1, min(end, self.longest) + 1):
            own = get(text[end - size : end])
            if own is not None:
                node = path[-size]
                s, n = score[node] + own, tokens[node] + 1
                if s > best or s == best and n < count:
                    best, count = s, n
        return best, count

    def count(self, text: str) -> int:
        """Tokens of one pre-token."""
        if len(text) > MAX_SHARED:
            score, tokens, path = [0.0], [0], [0]
            for end in range(1, len(text) + 1):
                s, n = self._forward(text, end, score, tokens, path)
                score.append(s)
                tokens.append(n)
                path.append(end)
            return tokens[-1]
        children, score, tokens = self.children, self.score, self.tokens
        node, path = 0, [0]
        for end, char in enumerate(text, 1):
            key = node * 0x110000 + ord(char)
            child = children.get(key)
            if child is None:
                s, n = self._forward(text, end, score, tokens, path)
                child = children[key] = len(score)
                score.append(s)
                tokens.append(n)
            node = child
            path.append(node)
        return tokens[node]

    def totals(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """(pre-tokens, tokens) of each text."""
        words = [t.split() for t in texts]
        if len(self.score) > MAX_NODES:
            self._renew()
        known = self.known
        long: dict[str, int] = {}
        for word in set().union(*words).difference(known):
            (known if len(word) < MAX_SHARED else long)[word] = self.count(MARK + word)
        if long:
            get = lambda w: known[w] if w in known else long[w]
        else:
            get = known.__getitem__
        return [len(w) for w in words], [sum(map(get, w)) for w in words]


_READY: dict[bytes, TokenTrie] = {}


def _trie(model_file: bytes) -> TokenTrie:
    key = hashlib.sha256(model_file).digest()
    if key not in _READY:
        _READY[key] = TokenTrie(piece_scores(model_file))
    return _READY[key]


def token_counts(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_pretokens`` and ``n_tokens`` by the pieces of a sentencepiece model file."""
    with open(path, "rb") as fh:
        shared = df.sparkSession.sparkContext.broadcast(fh.read())  # one file of fixed size

    def make():
        trie = _trie(shared.value)

        def step(texts):
            words, tokens = trie.totals([t or "" for t in texts])
            return {"n_pretokens": np.array(words, np.int64), "n_tokens": np.array(tokens, np.int64)}

        return step

    return map_texts(df, "n_pretokens bigint, n_tokens bigint", make, text, keep)
