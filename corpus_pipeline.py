"""From raw documents to token ids, in five stages over whole tables.

1. The quality classifier rejects documents.
2. Of near duplicates (five-word grams, Jaccard 0.8 or more) one document stays.
3. Personal data is masked.
4. Documents are repeated so that sources come to their target weights.
5. Texts are encoded to SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again before the next; all but the last keep the columns, further ones
and those with names that operators use inside included.

Defined results: null and empty texts are scored like any other and go on if they are
accepted; they are no one's duplicates, hold no personal data, are never repeated (their
size is 0) and have no ids. Rows that repeat an id are scored each and then one of them
stays; rows without an id go on unless a document with one has their text or a similar
one. Texts of any length are worked on whole. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm.classifier import accepted_documents
from changelens.llm.common import table, work_path
from changelens.llm.mixing import repeat_documents
from changelens.llm.ngram_join import JoinSettings, without_near_duplicates
from changelens.llm.pii import sanitised
from changelens.llm.sentencepiece import encode

MODEL = "piece_bpe_32k.model"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs, JoinSettings(width=5, num=80, den=100))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitised(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeat_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding", token_ids),
]

# Classifier, near duplicates and tokens can't be stated in SQL; tests/llm compares
# the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage gives is kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
