"""A training corpus from the documents: stages that each write Parquet and read what the stage before has written.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of ``docs``, whatever they are called; the last gives token ids.

Null texts are empty texts, and empty texts are documents: the classifier judges them by what it has learned, the
largest id of them stays as of other equal texts, they are linked with nothing, the mix takes them for no words, and they
have no tokens. A null id is the smallest. Rows that repeat an id and its text become one in the second stage; rows of one
id with different texts go together with the classifier and the n-gram join, which judge ids, and are texts of their own
elsewhere. Null sources and languages are groups of their own. Long texts are read whole. Of an empty table nothing is
left, with the same columns; without labels the classifier keeps everything.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from opsframe.llm import bpe, exact_dedup, mixing, ngram_join, quality_model
from opsframe.llm.common import drop_folders, folders_made, settle, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; rows that share an id go together, if all are rejected."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty), the row with the largest id stays, once."""
    return exact_dedup.deduplicate(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingles, the one with the smallest id stays."""
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two rows."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix, with their number and the digests of the ids and of what they decode to."""
    return bpe.token_ids(docs, bpe.read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", one_of_similar),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", tokens),
]

# The classifier is a trained model, which SQL cannot express; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the stages before have written is deleted once the next one has been."""
    docs, begin = table(spark, sf_dir, "documents"), folders_made()
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        drop_folders(begin, folders_made() - 1)
        begin = folders_made() - 1
    return docs
