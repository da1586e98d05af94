"""Corpus pipeline: five text operators as stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before it kept. Between
stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.common import new_path
from zonalis.llm.decontaminate import drop_contaminated
from zonalis.llm.pii_surrogates import surrogate_documents
from zonalis.llm.piece_codec import encode_pieces
from zonalis.llm.quality_rules import fit_ratios, keep_good
from zonalis.llm.queries import SURROGATE_KEY
from zonalis.llm.simhash import drop_near_copies


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the n-gram ratio keep: a row is judged by its text, so repeated rows and null ids like others; null and empty texts go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(spark, docs, fit_ratios(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the least id; of rows of one id and text one; null ids stay, null and empty texts are copies of each other."""
    return drop_near_copies(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands; null and empty texts stay, repeated rows and null ids are judged like others."""
    return drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; ``n_chars`` follows the new text. Null texts stay null, every row stays, equal texts stay equal."""
    out = surrogate_documents(spark, docs, SURROGATE_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the texts as ids of sentence pieces, a row each; none for null and empty texts."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", pii),
    ("SentencePiece encoding and decoding", pieces),
]

#: No SQL states these stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{k + 1}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
