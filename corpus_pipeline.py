"""The corpus pipeline: quality classifier, n-gram Jaccard join, mixing to target weights, BPE encoding.

Every stage takes rows with nulls in any column, empty, blank and very long
texts, repeated rows, an empty table and further columns of any name, and
states in its operator what it gives for them; all but the last return the
columns that they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.bpe import encode_documents
from quarry.llm.jaccard_join import Threshold, one_of_each
from quarry.llm.mixing import mixed
from quarry.llm.quality import accepted, train

#: SQL can't express the classifier, the draw and the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject; it learns from the labelled documents outside its held-out fold."""
    return accepted(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by five-word shingles at a Jaccard similarity of 0.8 or more."""
    return one_of_each(docs, Threshold(words=5, num=80, den=100))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: 150 % of all words, weights 3, 1, 2, twice each at most."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and the digest of what they decode to."""
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("mixing sources", mix), ("BPE encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
