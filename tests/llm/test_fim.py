"""Fill-in-the-middle against a plain version, on awkward rows and small blocks."""

from __future__ import annotations

import hashlib
import random

import pytest

from lumenfold.llm import fim
from lumenfold.llm.queries import QUERIES


def plain_version(doc_id, text):
    """(n, form, prefix, middle, output) of one row, by string slices."""
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows():
    pick = random.Random(3)
    parts = ["<", "P", "S", ">", "M", "a", "é", "中", "😀", "<P", "S>", "\0", "\n", "word "]
    made = [(i, "".join(pick.choice(parts) for _ in range(pick.choice([0, 1, 2, 5, 30])))) for i in range(600)]
    made += [(1000, None), (1001, ""), (None, "no id"), (None, None), (1002, "<P>x"), (1003, "x<M>"), (1004, "é😀" * 40_000)]
    return made + [(7, "again and again")] * 3


@pytest.mark.parametrize("block, step", [(1 << 20, 1_000_000), (5, 40)])
def test_equals_the_plain_version(spark, monkeypatch, block, step):
    monkeypatch.setattr(fim, "BLOCK", block)
    made = rows() if block > 100 else [r for r in rows() if len(r[1] or "") < 1000]
    df = spark.createDataFrame([(i, t, "x", None) for i, t in made], "doc_id long, text string, output string, _text int")
    got = fim.restore(fim.fill_in_middle(df, step_bytes=step), step_bytes=step).collect()
    want = [(i, *plain_version(i, t), t or "") for i, t in made]
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_blocks_do_not_change_the_result(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = pa.array([t for _, t in rows()][:300])
    draw = np.random.default_rng(1).integers(0, 2**32, (300, 4))
    data, edges = fim._bytes(texts)
    whole = fim.scatter(data, edges, draw, 90, 20)
    monkeypatch.setattr(fim, "BLOCK", 3)
    small = fim.scatter(data, edges, draw, 90, 20)
    assert all(np.array_equal(a, b) for a, b in zip(whole, small))
    back, back_edges = fim.gather(small[0], small[1], small[3], small[4])
    assert np.array_equal(back, data) and np.array_equal(back_edges, edges)


def test_restore_refuses_what_was_not_made_here(spark):
    df = spark.createDataFrame([("psm", "no marks")], "form string, output string")
    with pytest.raises(Exception, match="exactly three marks"):
        fim.restore(df).collect()


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None)], "form string, output string")
    assert fim.restore(df).first().restored is None
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim.restore(fim.fill_in_middle(none)).count() == 0


def test_query_contract(spark):
    got = QUERIES["op13_fill_in_middle"](spark, "/root/testdata/sf0.001")
    assert got.dtypes == [
        ("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"),
        ("output_sha256", "string"), ("restored_sha256", "string"),
    ]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for i, t in texts:
        *first, output = plain_version(i, t)
        want[i] = (i, *first, sha(output), sha(t or ""))
    assert sorted(map(tuple, got.collect())) == sorted(want.values())
