"""From raw documents to packed training windows, in five stages.

Each stage takes the documents that the stage before it left and returns them with the columns of
``documents``; the last returns pieces of packed windows. Null and empty texts, null ids and sources, repeated rows and
empty tables pass each stage with the result that its operator's docstring states; other columns are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import exact_dedup, ngram_join, packing, quality_classifier, suffix_dedup
from tessel.llm.common import documents, labels, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labels, does not reject."""
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, labels(spark, sf_dir))).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_winners(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with 5-word similarity of 0.8 or more."""
    return ngram_join.keep_one(docs).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier documents hold; n_chars is that of the text left."""
    left = suffix_dedup.remove_repeats(docs, keep_text=True, carry=("lang", "source"))
    return left.select("doc_id", "text", "carried.lang", "carried.source", F.length("text").cast("bigint").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens in the mixture of the sources."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("packing", pack),
]

#: Several stages are beyond SQL; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
