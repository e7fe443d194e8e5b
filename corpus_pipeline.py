"""A corpus pipeline: five stages over `documents`, each an operator of the training-data subpackage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.llm import bpe, decontam, language_id, near_dedup, substring_dedup
from glyphsieve.llm.queries import vocabulary_path
from glyphsieve.llm.storage import Scratch


def recognise_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of whose words half are recognised in the languages inferred for them, mixtures included."""
    return language_id.keep_recognised(docs, language_id.train(docs.filter(language_id.fold() != 1)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group linked at a five-word shingle similarity of 0.8 or more."""
    return near_dedup.keep_one_of_each(docs)


def strip_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out every window of 35 words that also starts elsewhere; documents left without a word go."""
    return substring_dedup.strip_repeats(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item at a similarity of 0.8 or more."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and digests of the ids and of what they decode to."""
    out = bpe.encode_and_decode(docs, vocabulary_path())
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", recognise_language),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", strip_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("BPE encoding and decoding", encode_tokens),
]

#: SQL can't express the stages; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        out = scratch.write(stage(spark, docs, sf_dir), f"stage{number}")
        scratch.drop(docs)
        docs = out
    return docs
