"""Corpus operators against brute force, the tokenizer library and exact round trips."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lumenfold.llm import bpe, components, decontam, langid, ordermin, quality, secrets, simhash, suffixes, unigram, warc
from lumenfold.llm.queries import BYTE_BPE, PIECES

SF001 = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, row string, fp long"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those of the operators."""
    rows = [
        (1, None, None, "a", 1), (2, "", "en", None, 2), (3, "  \n", "en", "c", 3), (4, "word", None, "d", None),
        (4, "word", None, "d", None), (None, "no id here at all", "de", "e", 5), (5, "é😀 " * 30_000, "fr", "f", 6),
        (6, "th" * 2500, "en", "g", 7), (7, "12 34 !?", "en", "h", 8),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- byte-level BPE ---------------------------------------------------------------

@pytest.fixture(scope="module")
def coder():
    with open(BYTE_BPE, "rb") as fh:
        return bpe.ByteBpe(fh.read())


@pytest.mark.parametrize("segment", [bpe.SEGMENT_CHARS, 7])
def test_bpe_equals_the_tokenizer_library(coder, monkeypatch, segment, texts):
    monkeypatch.setattr(bpe, "SEGMENT_CHARS", segment)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    pick = random.Random(1)
    pieces = [*" '  \n\t\r\x0b\u2003\u3000'stmdrevl''aBé1२½!.$中文😀\x1c", "'s", "'re", " 'll", "<|endoftext|>"]
    made = ["".join(pick.choice(pieces) for _ in range(pick.choice([0, 1, 3, 40]))) for _ in range(3000)]
    made += [*texts.values(), "a" * 3000, " " * 3000 + "x", ""]
    ids, edges = coder.encode(made)
    for i, text in enumerate(made):
        own = ids[edges[i] : edges[i + 1]]
        assert own.tolist() == want.encode_ordinary(text), text
        assert coder.decode(own) == text.encode()


def test_bpe_offsets_and_decoding(spark, odd):
    rows = bpe.bpe_encode(odd, BYTE_BPE)
    back = bpe.bpe_decode(rows, BYTE_BPE)
    want = sorted((t or "").encode() for t in (r.text for r in odd.collect()))
    assert sorted(bytes(r.decoded) for r in back.collect()) == want
    for r in rows.where("doc_id = 7").collect():
        assert r.offsets[0] == 0 and r.offsets == sorted(r.offsets) and len(r.offsets) == len(r.ids)


def test_bpe_digests(spark, odd, empty):
    for r, t in zip(bpe.bpe_digests(odd, BYTE_BPE).collect(), (r.text for r in odd.collect())):
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.bpe_digests(empty, BYTE_BPE).count() == 0


# -- SimHash ------------------------------------------------------------------------

def slow_fingerprint(text, words=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints, bits):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for p in prints:
        for q in prints:
            if (p ^ q).bit_count() <= bits:
                root[find(p)] = find(q)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("bits, max_list", [(2, 32), (2, 1), (1, 1), (1, 32), (0, 32)])
def test_links_connect_the_same_groups_as_all_pairs(spark, bits, max_list):
    pick = random.Random(7)
    prints = {pick.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(6):
            p ^= 1 << pick.randrange(64)
            prints.add(p)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), bits, max_list)
    pairs = [(r.a, r.b) for r in found.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= bits for a, b in pairs)
    roots = {r.node: r.root for r in components.components(found).collect()}
    want = collections.defaultdict(set)
    for p, r in slow_groups(prints, bits).items():
        want[r].add(p - (1 << 64) if p >> 63 else p)
    got = collections.defaultdict(set)
    for (p,) in signed:
        got[roots.get(p, p)].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_and_the_one_that_stays(spark, odd, empty, texts):
    docs = spark.createDataFrame([*texts.items(), (10_001, None), (10_000, ""), (10_001, None)], "doc_id long, text string")
    rows = simhash.near_duplicates(docs).collect()
    prints = {r.doc_id: slow_fingerprint(texts.get(r.doc_id)) for r in rows}
    assert all(r.fingerprint == f"{prints[r.doc_id]:016x}" for r in rows)
    groups = slow_groups(set(prints.values()), 2)
    least = {}
    for doc, p in prints.items():
        least[groups[p]] = min(doc, least.get(groups[p], doc))
    assert all(r.component_id == least[groups[prints[r.doc_id]]] for r in rows)
    assert len(rows) == len(texts) + 3
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(least.values())
    few = simhash.keep_one(odd)
    assert few.columns == odd.columns and sorted(r.doc_id or 0 for r in few.collect()) == [0, 1, 4, 5, 6, 7]
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {101: 100}


# -- decontamination ----------------------------------------------------------------

def test_decontamination_finds_all_similar_windows(spark, odd, empty):
    pick = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(pick.choices(vocabulary, k=pick.randint(14, 60)))) for i in range(40)]
    docs = []
    for d in range(200):
        words = pick.choices(vocabulary, k=pick.randint(0, 200))
        inside = items[pick.randrange(40)][1].split()
        for _ in range(pick.randrange(3)):  # edits near the ends keep the similarity high
            inside[pick.choice([0, 1, -1, -2])] = "changed"
        at = pick.randint(0, len(words))
        docs.append((d, " ".join(words[:at] + inside + words[at:]).title()))
    weights = {i: (collections.Counter(decontam.shingles(decontam.split_words(t))), len(t.split())) for i, t in items}
    want = {}
    for d, text in docs:
        words = decontam.split_words(text)
        grams = decontam.shingles(words)
        for i, (own, n) in weights.items():
            m = n - decontam.SHINGLE + 1
            each = [decontam.similarity(collections.Counter(grams[p : p + m]), own) for p in range(len(words) - n + 1)]
            if each and max(each) >= decontam.SIMILARITY:
                want[d, i] = max(each)
    items += [(90, None), (91, "too short"), (0, items[0][1])]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert 100 < len(want) and min(want.values()) < 1
    for chars in (decontam.BLOCK_CHARS, 2000):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontam.find_matches(frame, bench, chars).collect()}
        assert got == pytest.approx(want)
    clean = decontam.without_matches(frame, bench, 2000)
    assert sorted(r.doc_id for r in clean.collect()) == sorted({d for d, _ in docs} - {d for d, _ in want})
    assert decontam.without_matches(odd, bench).count() == odd.count()
    assert decontam.find_matches(odd, bench.where("false")).count() == 0 == decontam.find_matches(empty, bench).count()


def test_decontamination_of_documents_shorter_than_an_item_and_of_short_items(spark):
    pick = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, pick.choices(vocabulary, k=n)) for i, n in enumerate([45, 45, 30, 20, 15, 9, 5, 4, 3, 2, 1])]
    docs = [i[:-3] for _, i in items] + [i[2:] for _, i in items] + [i[5:-5] for _, i in items] + [i for _, i in items]
    docs += [[], ["x"], *([*pick.choices(["x", "y"], k=3), *i, *i, "z"] for _, i in items), [*items[0][1][:-3], "x"]]
    want = {}
    for d, words in enumerate(docs):
        for i, own in items:
            width = min(len(own), len(words))
            cut = lambda p: collections.Counter(" ".join(own) for own in slow_shingles(words[p : p + width]))  # noqa: E731, B023
            gold = collections.Counter(" ".join(g) for g in slow_shingles(own))
            each = [(-decontam.similarity(cut(p), gold), p) for p in range(len(words) - width + 1)] if width else []
            if each and -min(each)[0] >= decontam.SIMILARITY:
                want[d, i] = (-min(each)[0], min(each)[1], width)
    assert want[0, 0] == (38 / 41, 0, 42) and {i for _, i in want} == set(range(len(items)))
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = decontam.find_matches(frame, bench).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in found} == want and len(found) == len(want)
    clean = {r.doc_id for r in decontam.without_matches(frame, bench).collect()}
    assert clean == set(range(len(docs))) - {d for d, _ in want}


def slow_shingles(words):
    return [words[i : i + 5] for i in range(max(1, len(words) - 4))] if words else []


# -- secrets --------------------------------------------------------------------------

SLOW = (
    (re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


@pytest.fixture(scope="module")
def table(spark):
    return secrets.train(spark.read.parquet(f"{SF001}/documents.parquet"))


def test_base_spans_equal_plain_matching(spark, table, texts, odd):
    pick = random.Random(5)
    parts = ["token", "TOKEN", "Api_key", "apikey", "secret", "passwd", "=", ": ", ' = "', "'", " ", "abc", "abcdefgh", "AKIA", "AKIAABCDEFGH1234", "0123456789abcdef", "é", "😀", "\n", "ſecret", "x.y"]
    made = {i: "".join(pick.choices(parts, k=pick.randint(0, 40))) for i in range(10_000, 11_500)}
    made |= texts | {20_000: None, 20_001: "token=abcdefgh1 " * 700}
    frame = spark.createDataFrame([*made.items()], "doc_id long, text string")
    for r in secrets.scan(frame, table).collect():
        text = made[r.doc_id] or ""
        want = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(SLOW) for m in p.finditer(text) if ok(m))
        assert [tuple(s) for s in r.base] == want
        assert set(r.base) <= set(r.spans)
    assert secrets.scan(odd, table).count() == odd.count()


def test_markov_models_tell_random_from_ordinary(spark, table):
    words = ["internationalOrganisation", "user_account_settings", "path/to/some/longer/name", "THE_MAXIMUM_LENGTH_OF", "-" * 60, "=" * 30, "zzzzzzzzzzzzzzzzzzzzzzzzz", "2026-08-01-12-30-45-2026"]
    values = [base64.b64encode(hashlib.sha256(bytes([i])).digest()).decode() for i in range(20)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate([*values, *words])], "doc_id long, text string")
    found = {r.doc_id for r in secrets.scan(frame, table).where(secrets.count_kind(F.col("spans"), "random") > 0).collect()}
    assert found == set(range(20))


def test_random_keys_within_runs_and_short_ones(spark, table, texts):
    pick = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows, want = [], []
    path = "the/river/under/ordinary/stone/bridges/near/some/little/village/"
    for n in (*range(12, 20), 24, 32):
        for before, after in ((path, ""), (path, "/" + path[:-1]), ("the=", ""), ("/station?side=", "&other=1"), ("", ""), ("see ", " there")):
            rows.append((len(rows), before + "".join(pick.choices(letters, k=n)) + after))
            want.append([(len(before), len(before) + n)])
    key = "".join(pick.choices(letters, k=20))
    rows.append((len(rows), key + "/" + path + key))
    want.append([(0, 20), (21 + len(path), 41 + len(path))])
    words = re.findall("[A-Za-z]{2,15}", " ".join(t for t in texts.values() if t))
    names = (pick.choice("/_-=").join(words[i : i + 6]) for i in range(0, 12_000, 6))
    clean = [path[:-1], "linux/x86_64", "2026-08-01_12-30", "-_/=+" * 9, *(pick.choice([x, x.upper()]) for x in names)]
    rows += [(len(rows) + i, x) for i, x in enumerate(clean)]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()
    kind = secrets.KINDS.index("random")
    got = {r.doc_id: [(s.start, s.stop) for s in r.spans if s.kind == kind] for r in found}
    assert [got[i] for i in range(len(want))] == want
    false = [i for i in range(len(want), len(rows)) if got[i]]
    assert min(false, default=len(rows)) >= len(want) + 4 and len(false) < 0.01 * len(clean)


def test_redaction(spark, table, odd):
    hexes = "deadbeef" * 4
    rows = [(1, "a token=abcdefghij b", "x"), (2, None, "y"), (3, hexes, "z"), (4, "clean", None), (5, f"token={hexes} é {hexes}", "")]
    out = secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, spans string"), table).collect()
    assert [(r.doc_id, r.text) for r in sorted(out)] == [(1, "a [SECRET] b"), (2, None), (3, "[SECRET]"), (4, "clean"), (5, "[SECRET] é [SECRET]")]
    assert sorted(map(str, secrets.redact(odd, table).collect())) == sorted(map(str, odd.collect()))


# -- order MinHash ---------------------------------------------------------------------

def test_edited_texts_and_next_documents(spark, texts, monkeypatch):
    monkeypatch.setattr(ordermin, "SPAN_ROWS", 2)
    rows = {i * 7: " ".join(random.Random(i).choices("ab cc ddd e".split(), k=i % 30)) + "é" * (i % 3) for i in range(150)}
    rows |= {-5: None, 9000: "", 9001: "one two", 9002: "a " * 3000}
    got = {r.doc_id: r for r in ordermin.fingerprint_edits(spark.createDataFrame([*rows.items()], "doc_id long, text string")).collect()}
    order = sorted(rows)
    for i, d in enumerate(order):
        text, follow = rows[d] or "", rows[order[(i + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + follow[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        after = got[order[(i + 1) % len(order)]]
        cut = lambda s: [s[j : j + 8] for j in range(0, len(s), 8)]
        same = lambda a, b: sum(x == y for x, y in zip(cut(a), cut(b))) / ordermin.SKETCHES
        assert len(r.fingerprint) == 8 * ordermin.SKETCHES
        assert r.near_next == same(r.fingerprint, after.fingerprint) and r.near_edited == same(r.fingerprint, r.edited_fingerprint)
        assert (edited != text) or r.near_edited == 1


def test_order_counts_and_so_does_repetition(spark):
    words = [f"w{i}" for i in range(400)]
    swapped = words[200:] + words[:200]
    pick = random.Random(2)
    shuffled = pick.sample(words, 400)
    one_edit = words[:200] + ["new"] + words[201:]
    rows = [(0, words), (1, words), (2, swapped), (3, shuffled), (4, one_edit)]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "id long, text string")
    sig = {r.id: r.sig for r in ordermin.with_signature(frame, "text", "sig").collect()}
    near = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b])) / ordermin.SKETCHES
    # Swapping halves keeps nearly all k-mers but turns the order of many pairs.
    assert near(0, 1) == 1 and near(0, 4) > 0.9 and 0.2 < near(0, 2) < 0.8 and near(0, 3) < 0.05


# -- WARC ---------------------------------------------------------------------------------

def test_warc_round_trip(spark, workdir):
    tricky = "x\r\n\r\nWARC/1.1\r\nContent-Length: 99999999\r\n\r\nhaha" + "é" * 900
    rows = [
        (1, "http://a/x", "B" * 2000), (2, "http://a/y", "B" * 2000), (3, None, "B" * 2000), (4, "q", "s" * 10), (5, "q", "s" * 10),
        (6, "u", None), (7, "u", ""), (7, "u", ""), (8, "h://z\r\nX: y", tricky), (9, "h://z", "p\r\n\r\nWARC/1.1\r\nContent-Length: 2\r\n\r\nhi\r\n\r\nWARC/1.1\r\n"),
        (None, "n", "N" * 1500), (None, "n", "N" * 1500), (10, "k", "\r\n\r\n"), (11, "m", "B" * 2000), (11, "m", "B" * 2000),
        (12, "t", "WARC/1.1\r\n" * 300), (13, "v", "abWARC/1."), (14, "w", "WARC/1.0\r\n\r\nWARC/1."),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    want = sorted(str((p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest())) for p, _, h in rows)
    for compression, split in (("gzip", before), ("none", "700b")):
        path = f"{workdir}/{compression}"
        warc.write_warc(pages, path, 9, compression)
        spark.conf.set(size, split)
        try:
            got = warc.page_captures(spark, path).collect()
            whole = warc.transactions(spark, path).where("response.type = 'response'").collect()
        finally:
            spark.conf.set(size, before)
        assert sorted(str(tuple(r[:3])) for r in got) == want
        again = sorted(str((r.page_id, r.refers_to)) for r in got if r.record_type == "revisit")
        assert again == sorted(map(str, [(1, 11), (2, 11), (3, 11), (11, 11), (None, None)]))
        assert tricky.encode() in [bytes(r.payload) for r in whole] and all(len(r.requests) == len(r.metadata) == 1 for r in whole)


def test_many_records_cross_the_reader_s_buffers(spark, workdir):
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("http://a/b").alias("url"), F.repeat(F.lit("x"), F.col("id").cast("int") % 97).alias("html"))
    warc.write_warc(pages.coalesce(1), f"{workdir}/w")
    got = warc.page_captures(spark, f"{workdir}/w")
    assert got.count() == 4000 and got.where("payload_bytes <> page_id % 97").count() == 0


# -- token counts, language, quality, repeats ------------------------------------------------

def test_unigram_counts_equal_plain_dynamic_programming(spark, odd, empty):
    with open(PIECES, "rb") as fh:
        scores = unigram.piece_scores(fh.read())
    unknown = min(scores.values()) - unigram.FALLBACK

    def slow(word):
        word = unigram.MARK + word
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            each = [(-(best[end - 1][0] + unknown), best[end - 1][1] + len(word[end - 1].encode()))]
            each += [(-(best[s][0] + scores[word[s:end]]), best[s][1] + 1) for s in range(end) if word[s:end] in scores]
            least = min(each)
            best.append((-least[0], least[1]))
        return best[-1][1]

    trie = unigram.TokenTrie(scores)
    pick = random.Random(4)
    words = ["".join(pick.choices("thinkingédou中😀.", k=pick.randint(1, 20))) for _ in range(300)] + ["ab" * 60]
    assert [trie.totals([w])[1][0] for w in words] == [slow(w) for w in words]
    rows = unigram.token_counts(odd, PIECES).collect()
    assert [r.n_pretokens for r in rows[:4]] == [0, 0, 0, 1] and unigram.token_counts(empty, PIECES).count() == 0


def test_language_of_held_out_documents(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", F.col("doc_id") % 5 == 0)
    model = langid.fit(docs.where("not held"))
    got = langid.identify(docs.where("held"), model, keep=("lang",)).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got > 0.98
    rows = langid.identify(odd, model).collect()
    assert [r.lang_pred == "und" for r in rows] == [True, True, True, False, False, False, False, False, True]
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.known_language(odd, model).columns == odd.columns and langid.known_language(odd, model).count() == 5
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"} and langid.known_language(odd, none).count() == 5


def test_a_rare_language_is_learnt(spark, monkeypatch):
    pick = random.Random(6)
    word = lambda: "".join(pick.choices("abcdefgh", k=pick.randint(3, 7)))
    names = {k: [word() for _ in range(n)] for k, n in (("big", 4000), ("rare", 300))}
    text = lambda k: " ".join(pick.choices(names[k], k=20))
    rows = [("big", text("big")) for _ in range(29_970)] + [("rare", text("rare")) for _ in range(30)]
    train = spark.createDataFrame(rows, "lang string, text string")
    model = langid.fit(train, max_docs=3000, max_words=1000, max_grams=1000)
    assert len(model.words) == 1000 and len(model.grams) <= 1000
    held = [(k, text(k)) for k in ("big", "rare") for _ in range(200)]
    got = langid.identify(spark.createDataFrame(held, train.schema), model, keep=("lang",)).collect()
    right = collections.Counter(r.lang for r in got if r.lang == r.lang_pred)
    assert right["big"] >= 196 and right["rare"] >= 196
    # What a language lacks counts as much in both.
    floors = np.array([*model.words.values()]).min(axis=0)
    assert floors[0] == pytest.approx(floors[1])
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        langid.fit(train)


def test_quality_of_held_out_documents(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = quality.label_rows(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    rows = quality.features(docs.join(labels, "doc_id"), keep=("doc_id", "label"))
    model = quality.fit(rows.where("doc_id % 5 <> 0"))
    got = [(r.label, r.score) for r in quality.score(rows.where("doc_id % 5 = 0"), model, keep=("label",)).collect()]
    good, bad = ([s for label, s in got if label == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert all(0 <= r.score <= 1 for r in quality.score(quality.features(odd), model).collect())
    assert quality.fit(quality.features(empty).withColumn("label", F.lit(1))).constant == 0.5
    assert quality.fit(rows.where("label = 1")).constant == 1.0


@pytest.mark.parametrize("max_group", [32, 1, 4])
def test_repeated_passages_equal_all_windows(spark, max_group):
    pick = random.Random(9)
    shared = [[f"s{i}_{j}" for j in range(n)] for i, n in enumerate((50, 51, 60, 120, 49))]
    docs = {}
    for d in range(60):
        words = [f"x{pick.randrange(50)}" for _ in range(pick.randrange(150))]
        for _ in range(pick.randrange(3)):
            at = pick.randint(0, len(words))
            words[at:at] = pick.choice(shared)
        docs[d] = words
    docs[100], docs[101] = docs[7], []
    owners = collections.defaultdict(set)
    n = suffixes.MIN_WORDS
    for d, words in docs.items():
        for i in range(len(words) - n + 1):
            owners[tuple(words[i : i + n])].add(d)
    want = {}
    for d, words in docs.items():
        spans = []
        for i in range(len(words) - n + 1):
            if len(owners[tuple(words[i : i + n])]) > 1:
                if spans and i < spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + n)
                else:
                    spans.append((i, i + n))
        if spans:
            want[d] = spans
    rows = [(d, " ".join(w)) for d, w in docs.items()] + [(None, "a b"), (200, None), (201, ""), (202, "same " * 300)]
    got = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), max_group).collect()
    assert {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in got} == want
    # Links: exactly those to the least document of each window, or from it to another one.
    stars = collections.defaultdict(set)
    for members in owners.values():
        for d in members:
            if len(members) > 1 and d != min(members):
                stars[d].add(min(members))
    for r in got:
        assert stars[r.doc_id] <= set(r.partners) and r.partners == sorted(set(r.partners) - {r.doc_id})
        assert all(any(r.doc_id in m and p in m for m in owners.values()) for p in r.partners)


@pytest.mark.parametrize("max_group", [32, 1])
def test_links_of_overlapping_passages_and_rows_without_id(spark, empty, max_group):
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    two, one, both = words("a", 70), words("b", 70), words("c", 60)
    # Documents 5 and 6 alone share a passage that overlaps what each shares with another.
    docs = {2: two + both[:20], 1: one + both[:20], 5: two + both, 6: one + both, 9: words("z", 80), 10: words("q", 80), 11: words("q", 80)}
    rows = [(d, " ".join(w)) for d, w in docs.items()] * 2 + [(None, " ".join(words("z", 80)))] * 2
    found = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), max_group).collect()
    got = {r.doc_id: r.partners for r in found}
    assert got[5] == [2, 6] and got[6] == [1, 5] and got[2] == [5] and got[1] == [6] and got[10] == [11] and got[11] == [10]
    assert got[9] == [] and got[None] == [9] and len(found) == len(got) == 8
    assert suffixes.repeated_passages(empty).count() == 0
