"""Corpus pipeline: quality, language, near-duplicates, secrets, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet
to the shared folder and reads again as the next stage's docs. The first four return the columns of documents, whatever
they are called. Null and empty texts are judged like others (quality), go (language: no letter), are one class
(near-copies), have no secrets and are packed as their end id; equal rows fare alike but for near-copies, where one stays; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waystone.llm import language, order_minhash, packing, quality, secret_scan
from waystone.llm.queries import BYTE_BPE
from waystone.llm.shared import spent, table, written

#: A text whose language is told with less than this is rejected, like one without a letter.
LEAST_LANGUAGE_SCORE = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote doesn't mark as bad."""
    model = quality.fit(*quality.labelled_sample(docs, table(spark, sf_dir, "labels")))
    return quality.accepted(docs, model)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learned language; without labelled documents to learn from, those with a letter."""
    model = language.fit(*language.labelled_sample(docs))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language.recognised(docs, model, LEAST_LANGUAGE_SCORE)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of exact and near copies."""
    return order_minhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and n_chars counted anew where that happened."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 1024 tokens."""
    out = packing.pack_documents(docs, BYTE_BPE)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Stages 1 to 3 and 5 aren't SQL's to express; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            spent(before)
        before = docs
    return docs
