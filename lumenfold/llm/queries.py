"""Registered corpus queries: ``(spark, sf_dir) -> DataFrame`` over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import bpe, decontam, fim, langid, lattice, ordermin, quality, secrets, simhash, spelling, suffixes, unigram, warc
from lumenfold.llm.common import documents, held_out, remove_path, scratch_path, settle
from lumenfold.session import ensure_utc
from lumenfold.sources.tables import read_table

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand in two documents; (doc_id, spans, n_words, partners)."""
    return suffixes.repeated_passages(documents(ensure_utc(spark), sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in documents; (doc_id, item_id, similarity, start_word, n_words)."""
    docs = documents(ensure_utc(spark), sf_dir)
    return decontam.find_matches(docs, read_table(spark, sf_dir, "benchmark", ("item_id", "text")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document, by fixed patterns and by the Markov models."""
    docs = documents(ensure_utc(spark), sf_dir)
    found = secrets.scan(docs, secrets.train(docs))
    return found.select(
        "doc_id",
        *(secrets.count_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
        secrets.count_kind(F.col("spans"), "random").alias("n_random"),
    )


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of every document and of its edited text, with their likeness."""
    return ordermin.fingerprint_edits(documents(ensure_utc(spark), sf_dir))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC, read the archives back; a row per capture.

    The archives are removed once the (narrow) result stands in the checkpoint
    folder, as they are a means here. Rows written and captures read must agree.
    """
    pages = read_table(ensure_utc(spark), sf_dir, "pages")
    # The whole path: folders of a partitioned table repeat file names.
    row_id = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    path = scratch_path(spark, "warc")
    warc.write_warc(pages.select("page_id", "url", "html", row_id.alias("row_id")), path)
    result = settle(warc.page_captures(spark, path))
    remove_path(spark, path)
    written, read = pages.count(), result.count()
    if written != read:
        raise RuntimeError(f"{written} captures written, {read} read")
    return result


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document; (doc_id, n_pretokens, n_tokens)."""
    return unigram.token_counts(documents(ensure_utc(spark), sf_dir), PIECES)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return bpe.bpe_digests(documents(ensure_utc(spark), sf_dir), BYTE_BPE)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt outside the held-out fold; (doc_id, held_out, lang_pred, score)."""
    docs = documents(ensure_utc(spark), sf_dir, "doc_id", "text", "lang")
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
    model = langid.fit(docs.where("not held_out"))
    return langid.identify(docs, model, keep=("doc_id", "held_out"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt outside the held-out fold; (doc_id, held_out, score, predicted)."""
    docs = documents(ensure_utc(spark), sf_dir).withColumn("held_out", held_out(F.col("doc_id")))
    vectors = settle(quality.features(docs, keep=("doc_id", "held_out")))
    labels = quality.label_rows(read_table(spark, sf_dir, "labels", ("doc_id", "quality")))
    model = quality.fit(vectors.where("not held_out").join(labels, "doc_id").select("x", "label"))
    return quality.score(vectors, model, keep=("doc_id", "held_out"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups; (doc_id, fingerprint, component_id)."""
    return simhash.near_duplicates(documents(ensure_utc(spark), sf_dir), words=3, max_bits=2)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words with their nearest more frequent form; one run in 97 of each text is damaged first."""
    words = spelling.word_counts(documents(ensure_utc(spark), sf_dir), damage_every=97)
    return spelling.variants(words)


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document by words and by subword lattice, learnt outside the fold mod 7 = 2."""
    docs = documents(ensure_utc(spark), sf_dir).withColumn("held_out", held_out(F.col("doc_id"), 7, 2))
    rows = docs.withColumn("train", ~F.col("held_out"))
    return lattice.score_texts(rows, PIECES, "train", keep=("doc_id", "held_out"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut every document, write it with marks and restore it; form, lengths and digests of both texts."""
    cut = fim.restore(fim.fill_in_middle(documents(ensure_utc(spark), sf_dir)))
    digests = (F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_decontamination": op2_decontamination,
    "op3_secrets": op3_secrets,
    "op4_order_minhash": op4_order_minhash,
    "op5_warc": op5_warc,
    "op6_token_counts": op6_token_counts,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_language_id": op8_language_id,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_lm_scoring": op12_lm_scoring,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: DuckDB SQL where it can express a query.
SQL: dict[str, str] = {
    "op5_warc": """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS bytes FROM pages
), placed AS (
  SELECT *, bytes >= 1000 AND page_id < max(page_id) OVER same AS again, max(page_id) OVER same AS last
  FROM payloads WINDOW same AS (PARTITION BY html)
)
SELECT page_id, bytes AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
FROM placed
""",
    "op11_spelling_variants": """
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
         translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (
  SELECT id, run, count(*) AS n FROM runs GROUP BY id, run
), crc_steps AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM range(256) AS r(b)
), hashed AS (
  SELECT id, run, n, hex(encode(id || ':' || run)) AS h FROM counted
), coded AS (
  SELECT run, n, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM hashed, crc_steps
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN crc % 97 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word FROM coded
  ) GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3
), cut AS (
  SELECT word, n, i AS place, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS top, arg_min(near, {'n': -near_n, 'w': near}) AS form FROM near GROUP BY word
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN form END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n
  FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root FROM formed WHERE form IS NULL
  UNION ALL SELECT f.word, c.root FROM formed f JOIN chain c ON f.form = c.word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN chain USING (word)
""",
    "op13_fill_in_middle": """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), numbers AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2,
         ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4
  FROM drawn
), forms AS (
  SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM forms
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
""",
}
