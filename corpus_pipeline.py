"""The corpus pipeline: quality classifier, exact dedup, near-duplicate join, source mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from resultlens.llm.common import settle, table, word_count
from resultlens.llm.op1_best_fit_packing import packed
from resultlens.llm.op3_source_mixing import mixed
from resultlens.llm.op4_ngram_join import drop_near_copies
from resultlens.llm.op8_exact_dedup import drop_copies
from resultlens.llm.op10_quality_classifier import select_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the classifier, fit on `labels`, rejects go."""
    return select_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of equal texts one stays."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of documents linked at a Jaccard similarity of 0.8 over five-word shingles one stays."""
    return drop_near_copies(docs, 5, 80, 100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents as often as the mix takes them."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: pieces of documents in bins."""
    return packed(docs.select("doc_id", word_count(docs["text"]).alias("n_tokens")))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]

#: A fitted classifier and bin packing are beyond SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
