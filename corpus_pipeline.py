"""From raw documents to packed training sequences, stage by stage.

Every stage takes the documents that its predecessor kept, written as Parquet and read again. Rules reject documents of low quality, one document of
each near-duplicate group stays, repeated passages are cut, secrets are masked, and what is left is packed into sequences.

Defined cases are those of the operators: null and empty texts fall to the rules, rows that repeat are copies, null ids stay rows, an empty table goes through
all stages, and columns beyond those that a stage reads keep their names and values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastemill.llm import packing, quality, repeats, secrets, shingle_join
from tastemill.llm.common import table
from tastemill.session import work_path

#: Bytes from which on a repeated passage goes. Fifty words take 308 bytes on average in English and 335 to 345 in the other languages of the given
#: documents; one document in a hundred has words so short that they take less than 254 (277 elsewhere). Shorter strings cost more tables.
PASSAGE = 270


def with_length(before: DataFrame, after: DataFrame) -> DataFrame:
    """``n_chars``, where the documents have it, follows the text."""
    return after.withColumn("n_chars", F.char_length("text").cast(before.schema["n_chars"].dataType)) if "n_chars" in before.columns else after


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_length(docs, repeats.cut_repeats(docs, PASSAGE))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_length(docs, secrets.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Neither cutting repeated byte strings nor best-fit packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
