"""Language identification, words first with back-off to character n-grams.

The model counts words per language. A known word scores by its log frequency
in each language. An unseen word is scored by its character n-grams: the
longest length with a known n-gram decides (mean log frequency of those), then
the next shorter one, down to single letters. A text's language is the one with
the greatest sum; ``score`` is the softmax of the sums at that language.

``fit`` may learn from a bounded sample of the labelled rows (``max_docs``, and
``MIN_DOCS`` of every language or all its rows) and keeps a bounded model
(``max_words`` words, ``max_grams`` n-grams, the most frequent of every language and
length in turn), which is why it can be collected and broadcast; more than
``MAX_LANGUAGES`` languages are an error. What a language lacks has the same log
frequency in every language, however little a language has been seen. Scoring
covers every row and whole texts.

Null texts, texts without letters and any text under an empty model are ``und``
with score 0. Ties go to the alphabetically first language. Repeated rows score
alike.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import filter_texts, map_texts, settle

UNDETERMINED = "und"
#: Labelled rows that a model learns from (expected number; all if there are fewer).
MAX_DOCS = 20_000
#: Rows of each language at least (expected number; all if there are fewer).
MIN_DOCS = 500
MAX_WORDS = 50_000
MAX_GRAMS = 50_000
#: Languages that a model can tell apart.
MAX_LANGUAGES = 200
LONGEST_GRAM = 4
#: Added to every count of the language with the most; the others get the same log frequency for none.
PRIOR = 0.5
#: Words whose scores a worker keeps.
CACHE_WORDS = 200_000

_RUNS = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    """Lower-case runs of letters."""
    words = [w for w in _RUNS.findall(text.lower()) if w.isalpha()]
    return words or "".join(c if c.isalpha() else " " for c in text.lower()).split()


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]

    def __post_init__(self):
        self.rows = np.array([*self.grams.values()]).reshape(len(self.grams), len(self.languages))
        self.places = {g: i for i, g in enumerate(self.grams)}

    def score_words(self, words: list[str]) -> np.ndarray:
        """A row of scores per word: its own, or the mean over its longest known n-grams (none: zeros)."""
        out = np.zeros((len(words), len(self.languages)))
        flat, at, sizes = [], [], []
        get = self.places.get
        for i, word in enumerate(words):
            known = self.words.get(word)
            if known is not None:
                out[i] = known
                continue
            for n in range(LONGEST_GRAM, 0, -1):
                found = [p for x in grams(word, n) if (p := get(x)) is not None]
                if found:
                    flat += found
                    at.append(i)
                    sizes.append(len(found))
                    break
        if flat:
            edges = np.append(0, np.cumsum(sizes)[:-1])
            out[at] = np.add.reduceat(self.rows[flat], edges, axis=0) / np.array(sizes)[:, None]
        return out


def _sample(rows: DataFrame, sizes: dict[str, int], max_docs: int) -> DataFrame:
    """About ``max_docs`` rows and ``MIN_DOCS`` of each language, chosen by a hash of the text (the same every time)."""
    total = sum(sizes.values())
    if total <= max_docs:
        return rows
    parts = []
    for lang, n in sizes.items():
        share = min(1.0, max(max_docs / total, MIN_DOCS / n))
        parts += [F.lit(lang), F.lit(math.ceil(1_000_000 * share))]
    return rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.element_at(F.create_map(*parts), F.col("lang")))


def fit(
    rows: DataFrame,
    max_docs: int = MAX_DOCS,
    max_words: int = MAX_WORDS,
    max_grams: int = MAX_GRAMS,
) -> Model:
    """Learn from ``text`` and ``lang`` of ``rows`` (rows with a null in either are left out)."""
    rows = rows.select("text", "lang").where("text is not null and lang is not null")

    def make():
        return lambda texts: {"words": [letter_words(t) for t in texts]}

    found = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1)
    sizes = {r.lang: r.n for r in found.collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], {}, {})
    sample = _sample(rows, sizes, max_docs)
    words = map_texts(sample, "words array<string>", make, keep=("lang",))
    counts = words.select("lang", F.explode("words").alias("item")).groupBy("lang", "item").agg(F.count("*").alias("n"))
    counts = settle(counts)  # read three times below
    # One row per item with its count in every language.
    per_language = F.map_from_entries(F.collect_list(F.struct("lang", "n")))
    marked = F.concat(F.lit("<"), F.col("item"), F.lit(">"))

    def cut(n: int) -> Column:
        source = marked if n > 1 else F.col("item")
        last = F.length(source) - n + 1
        spots = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.substring(source, i, F.lit(n)))

    pieces = F.concat(*(cut(n) for n in range(1, LONGEST_GRAM + 1)))
    gram_counts = (
        counts.select("lang", "n", F.explode(pieces).alias("item"))
        .groupBy("lang", "item")
        .agg(F.sum("n").alias("n"))
    )

    def kept(df, limit, *group):
        # In turn the most frequent of every language (and length), so that none crowds others out.
        place = F.row_number().over(Window.partitionBy("lang", *group).orderBy(F.desc("n"), "item"))
        table = df.withColumn("place", place).groupBy("item").agg(
            F.sum("n").alias("total"), per_language.alias("by"), F.min("place").alias("place")
        )
        return table.where("total > 1").orderBy("place", F.desc("total"), "item").limit(limit).collect()

    # Log frequencies are relative to all words, or to all n-grams of a length.
    sums = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    gram_rows = kept(gram_counts, max_grams, F.length("item"))

    def logs(rows, totals, size):
        most = max(1, *(totals.get(k, 0) for k in languages))
        ratio = np.array([most / max(totals.get(k, 0), 1) for k in languages])
        scale = math.log(most + PRIOR * (size + 1))
        return {r.item: np.log(np.array([r.by.get(k, 0) for k in languages]) * ratio + PRIOR) - scale for r in rows}

    word_rows = kept(counts, max_words)
    gram_logs = {}
    for n in range(1, LONGEST_GRAM + 1):
        rows_n = [r for r in gram_rows if len(r.item) == n]
        totals = {k: sum(r.by.get(k, 0) for r in rows_n) for k in languages}
        gram_logs.update(logs(rows_n, totals, len(rows_n)))
    return Model(languages, logs(word_rows, sums, len(word_rows)), gram_logs)


class Scorer:
    """Languages and scores of texts; keeps the scores of the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self._renew()

    def _renew(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((4096, max(len(self.model.languages), 1)))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        languages = self.model.languages
        words = [letter_words(t) if t and languages else [] for t in texts]
        if len(self.index) > CACHE_WORDS:
            self._renew()
        index = self.index
        fresh = list(set().union(*words).difference(index))
        if fresh:
            while len(index) + len(fresh) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[len(index) : len(index) + len(fresh)] = self.model.score_words(fresh)
            index.update(zip(fresh, range(len(index), len(index) + len(fresh))))
        names, scores = [], []
        for own in words:
            if not own:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            sums = self.table[np.fromiter(map(index.__getitem__, own), np.int64, len(own))].sum(axis=0)
            best = int(np.argmax(sums))
            names.append(languages[best])
            scores.append(float(1 / np.exp(sums - sums[best]).sum()))
        return names, scores


_READY: dict[str, Scorer] = {}


def _scorer(key: str, shared: Broadcast) -> Scorer:
    """The worker's scorer for this model; one is kept."""
    if key not in _READY:
        _READY.clear()
        _READY[key] = Scorer(shared.value)
    return _READY[key]


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (0 to 1) per row."""
    shared, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def make():
        score = _scorer(key, shared)

        def step(texts):
            names, scores = score(texts)
            return {"lang_pred": names, "score": scores}

        return step

    return map_texts(df, "lang_pred string, score double", make, text, keep)


def known_language(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose language can be told, with all their columns.

    Under a model that learnt no language, the rows that have letters stay.
    """
    shared, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def make():
        score = _scorer(key, shared)
        if not shared.value.languages:
            return lambda texts: [bool(t) and bool(letter_words(t)) for t in texts]
        return lambda texts: [name != UNDETERMINED for name in score(texts)[0]]

    return filter_texts(df, make, text)
