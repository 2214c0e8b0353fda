"""Lattice scores against sums over all segmentations and a plain word model."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from lumenfold.llm import lattice
from lumenfold.llm.queries import PIECES, QUERIES
from lumenfold.llm.unigram import piece_scores

SMALL = {"▁": -2.0, "▁a": -1.5, "a": -2.0, "ab": -1.0, "b": -3.0, "abc": -2.5, "bc": -1.7, "é": -4.0, "aa": -2.2}


def segmentations(lat, word):
    """Every list of symbols that spells ``word``: pieces or the bytes of one character."""
    if not word:
        yield ()
        return
    for number, piece in enumerate(lat.pieces):
        if word.startswith(piece):
            for rest in segmentations(lat, word[len(piece) :]):
                yield (number, *rest)
    for rest in segmentations(lat, word[1:]):
        yield (*(lat.bytes_at + b for b in word[0].encode()), *rest)


WORDS = ["abc", "aab", "é", "ba", "", "中a", "abcab", "aaaa", "b😀"]


@pytest.mark.parametrize("shared, cells", [(128, 200_000), (128, 6), (1, 200_000)])
def test_marginals_and_expected_counts(monkeypatch, shared, cells):
    monkeypatch.setattr(lattice, "MAX_SHARED", shared)
    monkeypatch.setattr(lattice, "STEP_CELLS", cells)
    lat = lattice.Lattice(SMALL)
    assert math.isclose(np.exp(lat.weights).sum(), np.exp(list(SMALL.values())).sum() * (1 - lattice.BYTE_SHARE - lattice.END_SHARE) + lattice.BYTE_SHARE + lattice.END_SHARE)
    times = np.arange(1.0, len(WORDS) + 1)
    expected = np.zeros(len(lat.weights))
    got = lat.score(WORDS, times, expected)
    want = np.zeros(len(lat.weights))
    for word, n, log_p in zip(WORDS, times, got):
        paths = [(math.exp(sum(lat.weights[s] for s in p)), p) for p in segmentations(lat, lattice.MARK + word)]
        total = sum(w for w, _ in paths)
        assert math.isclose(log_p, math.log(total), abs_tol=1e-9), word
        for w, path in paths:
            for symbol in path:
                want[symbol] += n * w / total
    assert np.allclose(expected, want)


def test_long_words_score_alike(monkeypatch):
    lat = lattice.Lattice(piece_scores(open(PIECES, "rb").read()))
    pick = random.Random(2)
    words = ["".join(pick.choice("theand é中") for _ in range(300)).replace(" ", "") for _ in range(5)]
    expected = [np.zeros(len(lat.weights)) for _ in range(2)]
    alone = lat.score(words, np.ones(5), expected[0])
    monkeypatch.setattr(lattice, "MAX_SHARED", 1000)
    assert np.allclose(alone, lat.score(words, np.ones(5), expected[1]))
    assert np.allclose(*expected)


def plain_scores(rows):
    """The whole operator in plain Python: (n_tokens, n_known, train_tokens, base_score, score) per row."""
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, _ in rows]
    texts = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) for _, t in rows]
    counts = collections.Counter(w for words, h in zip(texts, held) if not h for w in words)
    ends = held.count(False)
    total, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
    lat = lattice.Lattice(piece_scores(open(PIECES, "rb").read()))
    if ends:
        expected = np.zeros(len(lat.weights))
        if counts:
            lat.score(list(counts), np.array(list(counts.values()), float), expected)
        expected[-1] = ends
        p = expected + lattice.PRIOR * len(expected) * np.exp(lat.weights)
        lat = lattice.Lattice(piece_scores(open(PIECES, "rb").read()), np.log(p / p.sum()))
    known = set().union(*texts)
    log_p = dict(zip(known, lat.score(list(known)) if known else []))
    out = []
    for words, h in zip(texts, held):
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        base += math.log10((ends + 1) / (total + distinct + 1))
        score = (sum(log_p[w] for w in words) + lat.end) / math.log(10)
        out.append((h, len(words) + 1, sum(counts[w] > 0 for w in words) + (ends > 0), total, base, score))
    return out


def check(got, rows):
    order = lambda r: tuple((x is None, str(x)) for x in r[:3]) + tuple(r[3:])
    got = sorted((tuple(r) for r in got), key=order)
    want = sorted(((i, *w) for (i, _), w in zip(rows, plain_scores(rows))), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-9)


@pytest.mark.parametrize("chunk", [30, 8_000_000])
def test_equals_plain_version(spark, chunk):
    rows = [(1, "The cat sat"), (2, None), (3, ""), (4, "the CAT\x0bsat x 中中 ÀB"), (None, "the"), (5, "x" * 5000), (6, " \n")]
    rows += [(7, "the the the")] * 4 + [(10 + i, f"w{i} the {'z' * i}") for i in range(30)]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, chunk int, word string")
    df = df.withColumn("held_out", lattice_held(df)).selectExpr("*", "not held_out as train")
    got = lattice.score_texts(df, PIECES, "train", keep=("doc_id", "held_out"), chunk_bytes=chunk).collect()
    check(got, rows)


def lattice_held(df):
    from lumenfold.llm.common import held_out

    return held_out(df.doc_id, 7, 2)


def test_nothing_to_learn_from_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string").selectExpr("*", "false as train")
    got = {r.doc_id: r for r in lattice.score_texts(df, PIECES, "train").collect()}
    assert got[1].train_tokens == 0 and got[1].n_known == 0 and got[1].base_score == 0 and got[1].score < got[2].score < 0
    assert lattice.score_texts(df.where("doc_id < 0"), PIECES, "train").count() == 0


def test_query_contract(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op12_lm_scoring"](spark, sf)
    assert got.dtypes == [
        ("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"),
        ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double"),
    ]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(got.collect(), rows)


def test_learnt_weights_fit_unseen_texts_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "crc32(string(doc_id)) % 7 <> 2 as train")
    held = docs.where("not train").selectExpr("doc_id")
    learnt = lattice.score_texts(docs, PIECES, "train").join(held, "doc_id").agg({"score": "sum"}).first()[0]
    plain = lattice.score_texts(docs.selectExpr("doc_id", "text", "false as train"), PIECES, "train").join(held, "doc_id").agg({"score": "sum"}).first()[0]
    assert learnt > plain
