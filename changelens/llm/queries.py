"""Registered queries: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from changelens.llm.classifier import score_documents
from changelens.llm.common import table, work_path
from changelens.llm.conversations import shared_prefix_trie
from changelens.llm.decontamination import Windows, contamination
from changelens.llm.embeddings import near_duplicate_vectors
from changelens.llm.mixing import mixture
from changelens.llm.ngram_join import CONTRACT, near_duplicates
from changelens.llm.pii import span_report
from changelens.llm.resampling import Resampling, resampled
from changelens.llm.rules import judged
from changelens.llm.sentencepiece import encoded_digest
from changelens.llm.urls import Rule, judged_urls
from changelens.llm.warc import read_archive, write_archive
from changelens.llm.wavelet import read_tokens, write_tokens

PIECE_MODEL = "piece_bpe_32k.model"
WORD_TOKENIZER = "word_bpe_49k.json"
URL_RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return encoded_digest(table(spark, folder, "documents"), public_tokenizers.path(PIECE_MODEL))


def op2_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, folder, "embeddings"), cosine=0.95, recall=0.99)


def op3_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), CONTRACT)


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = work_path(spark, "warc")
    write_archive(table(spark, folder, "pages"), archive)
    return read_archive(spark, archive, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return span_report(table(spark, folder, "documents"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    trusted = table(spark, folder, "labels").where("quality = 1")
    return judged(table(spark, folder, "documents"), trusted).drop("score")


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_wavelet_tokens(spark: SparkSession, folder: str) -> DataFrame:
    index = work_path(spark, "tokens")
    write_tokens(table(spark, folder, "documents"), public_tokenizers.path(WORD_TOKENIZER), index)
    return read_tokens(spark, index, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return judged_urls(table(spark, folder, "pages"), URL_RULES).drop("score")


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    settings = Resampling(width=1, buckets=10_000, percent=10, min_words=20, seed=2024)
    return resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"), settings)


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), Windows(width=10))


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return shared_prefix_trie(table(spark, folder, "conversations"), limit=9, step=5)


def queries() -> dict[str, Query]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_embedding_near_dedup": op2_embedding_near_dedup,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op4_warc": op4_warc,
        "op5_pii": op5_pii,
        "op6_quality_rules": op6_quality_rules,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_wavelet_tokens": op8_wavelet_tokens,
        "op9_mixing": op9_mixing,
        "op10_url_filters": op10_url_filters,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_decontamination": op12_decontamination,
        "op13_conversation_trie": op13_conversation_trie,
    }
