"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet below the checkpoint folder and reads it back for the next stage.
Empty tables and tables without any kept row pass through with their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import bpe, decontam, langid, secrets, simhash
from lumenfold.llm.common import held_out, remove_path, scratch_path
from lumenfold.llm.queries import BYTE_BPE
from lumenfold.session import ensure_utc
from lumenfold.sources.tables import read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told (8); ``und`` goes."""
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    return langid.known_language(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (10), the one with the least doc_id."""
    return simhash.keep_one(docs, words=3, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark (2)."""
    return decontam.without_matches(docs, read_table(spark, sf_dir, "benchmark", ("item_id", "text")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret span replaced (3), ``n_chars`` after it."""
    clean = secrets.redact(docs, secrets.train(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids by byte-level BPE (7): count, digest of the ids and of what they decode to."""
    return bpe.bpe_digests(docs, BYTE_BPE)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither the hashes of SimHash nor the token merges; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(ensure_utc(spark), sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return docs
