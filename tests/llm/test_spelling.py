"""Spelling variants against a comparison of every word with every word."""

from __future__ import annotations

import collections
import random
import re
import zlib

import pytest

from lumenfold.llm import spelling
from lumenfold.llm.queries import QUERIES

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def is_near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows, every):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_variants(counts):
    near = collections.defaultdict(list)
    words = sorted(counts)
    by_length = collections.defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    for w in words:
        for size in (len(w) - 1, len(w), len(w) + 1):
            near[w] += [v for v in by_length[size] if v != w and is_near(w, v)]
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def made_words(n, seed):
    pick = random.Random(seed)
    words = set()
    while len(words) < n:
        stem = "".join(pick.choice("abàÿ") for _ in range(pick.choice([5, 5, 6, 7, 8, 12])))
        words.add(stem)
        at = pick.randrange(len(stem))
        words.add(stem[:at] + pick.choice("abz") + stem[at + pick.choice([0, 1]) :])
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "aaaaab", "x" * 70, "x" * 71, "x" * 30 + "y" + "x" * 40, "q" * 3000, "q" * 2999}
    words = {w for w in words if len(w) >= 5}
    return {w: pick.choice([3, 4, 6, 9, 12, 30, 100]) for w in sorted(words)}


@pytest.mark.parametrize("tile", [4096, 7])
def test_equals_every_pair_compared(spark, monkeypatch, tile):
    counts = made_words(1500, 5)
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = {r.word: tuple(r) for r in spelling.variants(df, tile).collect()}
    assert got == plain_variants(counts)


def test_near_pairs_come_once(spark):
    counts = made_words(600, 6)
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    pairs = [(r.word, r.near) for r in spelling.near_pairs(df, 9).collect()]
    assert len(pairs) == len(set(pairs)) > 500


def test_large_blocks_by_strips(monkeypatch):
    import numpy as np

    monkeypatch.setattr(spelling, "STRIP", 16)
    rows = np.random.default_rng(1).integers(0, 3, (300, 4)).astype(np.float32)
    edges = np.array([0, 100, 101, 130, 300])
    found = [tuple(x) for part in spelling._close(rows, edges) for x in zip(*map(list, part))]
    want = []
    for a, b in zip(edges[:-1], edges[1:]):
        for i in range(a, b):
            want += [(i, j, d) for j in range(i + 1, b) if (d := float(((rows[i] - rows[j]) ** 2).sum())) <= 2]
    assert sorted(found) == sorted(want)


def test_word_counts(spark, monkeypatch):
    pick = random.Random(4)
    letters = ["Th", "e", "À", "ÿ", "é", "×", " ", "-", "中", "1", "ß", "ŕ", "\n", "in", "Ingen"]
    rows = [(i, "".join(pick.choice(letters) for _ in range(60))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (None, "Ingen ingen INGEN ÀÀÀÀÀ"), (1002, "theine " * 50_000)] + [(5, "again again ÀÀÀÀÀ")] * 3
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    for every in (None, 3, 97):
        got = {r.word: r.n for r in spelling.word_counts(df, damage_every=every).collect()}
        assert got == plain_counts(rows, every)


def test_chains_of_forms(spark):
    words = ["abcde", "abcdex", "abcdexy", "abcdexyz", "abcdexyzw", "abcdexyzwv"]
    counts = {w: 3 * 2**i for i, w in enumerate(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = {r.word: tuple(r) for r in spelling.variants(df).collect()}
    assert got == plain_variants(counts)
    assert got["abcde"][2] == words[-1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(none)).count() == 0


def test_query_contract(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op11_spelling_variants"](spark, sf)
    assert got.dtypes == [
        ("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint"),
    ]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.word: tuple(r) for r in got.collect()} == plain_variants(plain_counts(rows, 97))
