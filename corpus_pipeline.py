"""The corpus pipeline: quality rules, near-dedup, PII surrogates, source mixing, SentencePiece encoding.

Each stage takes the documents that its predecessor kept and returns documents with the same columns, the
last one the encoded texts. run() writes each stage's result as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylark.llm import mixing, near_dedup, piece_lattice, quality_rules, surrogates
from skylark.llm.common import written
from skylark.llm.queries import TOKENIZERS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected; null and empty texts go."""
    return quality_rules.judge_measured(quality_rules.text_measures(docs)).filter("kept").select(COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (similarity 0.8), the one with the smallest id, of these the least text hash.

    Rows without id are in the groups of their copies and come last; unrelated texts under one id all stay, as
    do texts without words.
    """
    numbered = near_dedup.numbered_rows(docs.select(COLUMNS))
    heads = near_dedup.near_rows(numbered, percent=80).filter("_row = head").select("_row")
    return numbered.join(written(heads), "_row").select(COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by keyed surrogates; n_chars follows the new text."""
    return surrogates.replace_entities(docs, key="pipeline").withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times (0 to 2) as the mix takes it."""
    return mixing.mix_documents(docs).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, score and ids of the best segmentation of each whole text, others: the ids of the next three (all, if fewer), best first."""
    return piece_lattice.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model", n=4)


STAGES = [("quality rules", quality), ("near-dedup", dedup), ("PII", pii), ("mixing", mix), ("encoding", encode)]

#: Near-dedup, keyed surrogates and the piece lattice can't be stated in SQL; the tests hold brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
