"""A training-data pipeline over ``documents``: five operators, each written as Parquet and read again.

Stages but the last take and return the columns of ``documents``; what a stage removes is gone for the
next.  Repeated rows, null and empty texts pass through as the operators say; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import staged
from quillsift.llm.line_dedup import dedup_lines
from quillsift.llm.mixing import sample_mixture
from quillsift.llm.ngram_join import one_of_each
from quillsift.llm.packing import pack, public_tokenizer
from quillsift.llm.quality import keep_good


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts, learned from all labels."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line resembles are taken out; documents left without any text go."""
    out = dedup_lines(docs, min_words=1, drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar word shingles (five words, 0.8) the one with the smallest doc_id."""
    return one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the source mixture takes them: not at all, once or twice."""
    return sample_mixture(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences of that length."""
    return pack(docs, public_tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Compression, tries and flows have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
