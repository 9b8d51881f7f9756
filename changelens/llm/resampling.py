"""Draw documents so that their features come near those of a target text set.

Importance resampling on hashed word runs: a bucket's gain is the logarithm of how much
more often its features occur in the target than in the documents (both smoothed by one
per bucket), in thousandths, rounded down. A document weighs the sum of its gains; a
Gumbel number that depends on the seed and its id only is added, and the highest sums
are drawn, which is a draw without replacement in proportion to the weights.

Buckets are counted in the tasks that read the texts, one array per task. The gains are
an array with one number per bucket, which every task gets, so scoring is an array
look-up. Of the eligible documents those that may be drawn are found with a histogram
of the scores; they alone take part in the radix sort that gives the ranks (`radix`).

Defined results: A-Z are lower-cased, words are runs of ASCII letters, digits and all
other characters beyond ASCII; null and empty texts have no features and weight 0; texts
of any length are read in parts; equal scores rank by id, ids that repeat by their
number of features, a null id (hashed as `null`) last; every row of a repeated document
counts and may be drawn by itself; without target texts or documents counts are 0; an
empty table gives an empty result. Columns but doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import docs_of, pinned, slices
from changelens.llm.radix import ranked


@dataclass(frozen=True)
class Resampling:
    """Runs of 1 to `width` words are features; `percent` of the documents with at least
    `min_words` words are drawn; `steps`: bars of the histogram that bounds the sort."""

    width: int = 1
    buckets: int = 10_000
    percent: int = 10
    min_words: int = 20
    seed: int = 2024
    steps: int = 4096


_PART = 1 << 20
_CLEAN = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists; a long text is cut between words."""
    clean, at = text.translate(_CLEAN), 0
    while len(clean) - at > 2 * _PART:
        cut = clean.find(b" ", at + _PART)
        if cut < 0:
            break
        yield clean[at:cut].split()
        at = cut
    yield clean[at:].split()


def feature_buckets(text: bytes, settings: Resampling) -> tuple[list[np.ndarray], int]:
    """The buckets of all features, in arrays, and the number of words."""
    found, n_words, carried = [], 0, []
    for words in word_lists(text):
        n_words += len(words)
        joined = carried + words
        sums = list(map(crc32, joined))
        for n in range(1, settings.width + 1):
            if n > 1:
                sums = [crc32(b" " + joined[i + n - 1], sums[i]) for i in range(len(joined) - n + 1)]
            new = sums[max(0, len(carried) - n + 1) :]
            found.append(np.array(new, np.int64) % settings.buckets)
        carried = joined[max(0, len(joined) - settings.width + 1) :] if settings.width > 1 else []
    return found, n_words


def bucket_counts(texts: DataFrame, settings: Resampling) -> np.ndarray:
    """Features per bucket over all rows of the column text. The driver gets one number
    per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, np.int64)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                for part in feature_buckets(text or b"", settings)[0]:
                    total += np.bincount(part, minlength=settings.buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("binary")).mapInArrow(count, "bucket int, n long")
    counts = np.zeros(settings.buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    n = len(raw)
    all_raw, all_target = int(raw.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (all_raw + n) / ((s + 1) * (all_target + n))))
            for s, t in zip(map(int, raw), map(int, target), strict=True)
        ],
        np.int64,
    )


def weighed(docs: DataFrame, gains: np.ndarray, settings: Resampling) -> DataFrame:
    """doc_id, n_features, n_words, weight and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)  # one number per bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns: tuple[list[int], ...] = ([], [], [])
            for text in batch.column("text").to_pylist():
                parts, n_words = feature_buckets(text or b"", settings)
                row = sum(map(len, parts)), n_words, sum(int(sent.value[p].sum()) for p in parts)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            numbers = [pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers], ["doc_id", "n_features", "n_words", "weight"])

    rows = docs_of(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(weigh, "doc_id long, n_features long, n_words long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return found.withColumn("score", (F.col("weight") + gumbel).cast("long"))


def _least_score(scored: DataFrame, draw: int, settings: Resampling) -> int | None:
    """A score that at least `draw` rows reach, from a histogram of all scores."""
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    if low is None or not draw:
        return None
    step = (high - low) // settings.steps + 1
    bar = F.floor((F.lit(high) - F.col("score")) / step).cast("int")
    seen = 0
    for row in scored.groupBy(bar.alias("bar")).agg(F.count(F.lit(1)).alias("n")).orderBy("bar").collect():
        seen += row["n"]
        if seen >= draw:
            return high - step * (row["bar"] + 1) + 1
    return low


def resampled(docs: DataFrame, target: DataFrame, settings: Resampling | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, n_features, weight, score and rank among the drawn (else
    null). `target` has the column text."""
    settings = settings or Resampling()
    gains = bucket_gains(bucket_counts(docs_of(docs, "text"), settings), bucket_counts(docs_of(target, "text"), settings))
    scored = pinned(weighed(docs, gains, settings))
    eligible = F.col("n_words") >= settings.min_words
    draw = scored.where(eligible).count() * settings.percent // 100
    least = _least_score(scored.where(eligible), draw, settings)
    columns = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    close = eligible & (F.col("score") >= least)
    key = {
        "__falling": -F.col("score"),
        "__no_id": F.col("doc_id").isNull().cast("long"),
        "__id": F.coalesce("doc_id", F.lit(0)),
        "__size": F.col("n_features"),
    }
    order = ranked(scored.where(close).select(*columns, *[v.alias(k) for k, v in key.items()]), list(key))
    rank = F.when(F.col("rank") <= draw, F.col("rank"))
    rest = scored.where(~close).select(*columns, F.lit(None).cast("long").alias("rank"))
    return order.select(*columns, rank.alias("rank")).unionByName(rest)


def drawn_documents(docs: DataFrame, target: DataFrame, settings: Resampling | None = None) -> DataFrame:
    """The drawn rows of `docs` with all their columns; rows that repeat an id come together."""
    ids = resampled(docs, target, settings).where("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(F.col("__drawn")), "left_semi")
