"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams.

Words and pairs of neighbouring words (A-Z lower-cased) are hashed to buckets. Two
multinomials over the buckets are counted: one over all documents, one over those a
trusted label marks. A document's score is the mean over its n-grams of
log p_trusted - log p_all, so length doesn't matter; each log ratio is rounded to a
multiple of 2^-20 first, which makes sums exact and verdicts the same in every run.
A document is kept if it passes the base rules and scores `threshold` or more.

Defined results: a null or empty text has no words and fails the base rules; without
trusted documents (or any words in them) all scores are 0 and only the base rules
decide; repeated rows count as often as they occur and get equal verdicts; ids may be
null, but then match no label; an empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import slices
from changelens.llm.stats import covered_words, mixed, repeated_lines, word_hashes

_SCALE = 1 << 20
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACES = np.frombuffer(b" \t\n\x0b\f\r", np.uint8)
_FACTORS = mixed(np.arange(11, 14, dtype=np.uint64)) | np.uint64(1)


@dataclass(frozen=True)
class Rules:
    """min_words and max_repeated (percent of words): base rules; buckets: a power of two;
    prior: weight, in n-grams per bucket, of the whole corpus in the trusted multinomial,
    so that few trusted documents say little; threshold: least mean log ratio."""

    min_words: int = 50
    max_repeated: int = 50
    buckets: int = 1 << 14
    prior: float = 8.0
    threshold: float = -0.05


def ngram_buckets(text: bytes, buckets: int) -> np.ndarray:
    """Buckets of the words and word pairs of a text."""
    h = word_hashes(text.lower())
    pairs = mixed(h[:-1] * _FACTORS[0] + h[1:] * _FACTORS[1])
    return (np.concatenate([mixed(h), pairs]) & np.uint64(buckets - 1)).astype(np.int64)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _counted(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket and n, added up by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counts += np.bincount(ngram_buckets(_bytes(text), buckets), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket int, n long")


def log_ratios(docs: DataFrame, trusted: DataFrame, rules: Rules) -> np.ndarray:
    """Scaled integer log ratio of each bucket. Counts are summed by Spark; the driver
    gets two numbers per bucket."""
    known = trusted.select("doc_id").distinct()
    # Labels grow with the corpus: the same join at every size, never a broadcast.
    target = docs.select("doc_id", "text").join(known.hint("merge"), "doc_id", "left_semi")
    both = _counted(docs, rules.buckets).withColumn("kind", F.lit(0)).union(
        _counted(target, rules.buckets).withColumn("kind", F.lit(1))
    )
    counts = np.zeros((2, rules.buckets))
    for row in both.groupBy("kind", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["kind"], row["bucket"]] = row["n"]
    if not counts[1].any():
        return np.zeros(rules.buckets, np.int64)
    every = (counts[0] + 1) / (counts[0].sum() + rules.buckets)
    weight = rules.prior * rules.buckets
    trusted_share = (counts[1] + weight * every) / (counts[1].sum() + weight)
    return np.rint((np.log(trusted_share) - np.log(every)) * _SCALE).astype(np.int64)


def judge(text: bytes, ratios: np.ndarray, rules: Rules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept."""
    words = word_hashes(text)
    n = len(words)
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(bytes_.sum() - bytes_[0x80:0xC0].sum())
    repeated = covered_words(words)
    grams = ngram_buckets(text, rules.buckets)
    total = int(ratios[grams].sum())
    failed = n < rules.min_words or 100 * repeated > rules.max_repeated * n
    least = int(rules.threshold * _SCALE)
    return (
        n,
        chars - int(bytes_[_SPACES].sum()),
        int(bytes_[_SYMBOLS].sum()),
        repeated_lines(text),
        repeated,
        total / _SCALE / max(1, len(grams)),
        failed,
        not failed and total >= least * len(grams),
    )


_VERDICT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "score double, base_failed boolean, kept boolean"
)


def judged(docs: DataFrame, trusted: DataFrame, rules: Rules | None = None) -> DataFrame:
    """doc_id and the verdict columns of every document. `trusted` has a doc_id column."""
    rules = rules or Rules()
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, trusted, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [judge(_bytes(t), ratios.value, rules) for t in batch.column("text").to_pylist()]
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns], ["doc_id", *_VERDICT.replace(",", "").split()[::2]]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_VERDICT}")
