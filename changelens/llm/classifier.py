"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics. Per class the mean
and a covariance shrunk towards the pooled one (the more, the fewer rows the
class has) are learned from labelled rows; a text is scored by the difference of two Mahalanobis log densities, computed
with Cholesky factors that are inverted once and sent to the tasks.

Defined results: a null or empty text has the statistics of no words and is
scored like any other; labels other than 0 and 1 are ignored; a document with
several labels counts once for each; repeated rows get equal scores; if one
class has no labelled row, every score is the share of label 1 (0.5 without
any labels at all); an empty table gives an empty result. Ids may be null and
stay so. Columns other than those named are never read or, in
`accepted_documents`, passed through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import pinned, slices
from changelens.llm.stats import repeated_lines, repeated_words, word_ids

FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_spread", "upper", "digits", "symbols", "marks", "spaces",
    "distinct_words", "top_word", "repeated_words", "repeated_lines", "line_length", "alone_symbols", "shouted_words",
)
SHRINKAGE = 0.1
RIDGE = 0.1

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>{}[]\\^~=_@/")] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?.,;:'\"()-")] = True
_SPACES = np.zeros(256, bool)
_SPACES[list(b" \t\n\x0b\f\r")] = True
# Columns: upper case, digits, symbols, marks, white space, first bytes of characters.
_KINDS = np.stack(
    [
        (np.arange(256) >= 65) & (np.arange(256) <= 90),
        (np.arange(256) >= 48) & (np.arange(256) <= 57),
        _SYMBOLS,
        _MARKS,
        _SPACES,
        (np.arange(256) & 0xC0) != 0x80,
    ],
    1,
).astype(np.float64)


def _logit(share: float, n: float) -> float:
    """Log odds of a share of n cases, half a case added to both sides."""
    k = share * n
    return float(np.log((k + 0.5) / (n - k + 0.5)))


def statistics(text: str | None) -> np.ndarray:
    """The feature vector of one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    bytes_ = np.frombuffer(data, np.uint8)
    upper, digits, symbols, marks, spaces, chars = np.bincount(bytes_, minlength=256) @ _KINDS
    words = data.split()
    n = len(words)
    ids = word_ids(words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    top = np.bincount(ids).max() if n else 0
    lines = data.count(b"\n") + 1
    shouted = sum(w.isupper() and len(w) > 2 for w in words)
    alone = sum(not w[0] & 0x80 and not w.isalnum() and len(w) < 3 for w in words)
    return np.array(
        [
            np.log1p(chars),
            np.log1p(n),
            np.log(lengths.mean()) if n else 0.0,
            np.log1p(lengths.std()) if n else 0.0,
            _logit(upper / max(chars, 1), min(chars, 1000)),
            _logit(digits / max(chars, 1), min(chars, 1000)),
            _logit(symbols / max(chars, 1), min(chars, 1000)),
            _logit(marks / max(chars, 1), min(chars, 1000)),
            _logit(spaces / max(chars, 1), min(chars, 1000)),
            _logit((ids.max() + 1) / n if n else 1.0, min(n, 200)),
            _logit(top / max(n, 1), min(n, 200)),
            _logit(repeated_words(ids) / max(n, 1), min(n, 200)),
            _logit(min(1.0, repeated_lines(data) / lines), min(lines, 50)),
            np.log1p(chars / lines),
            _logit(alone / max(n, 1), min(n, 200)),
            _logit(shouted / max(n, 1), min(n, 200)),
        ]
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and features (array of doubles), from one reading of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, features array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverted Cholesky factors and log weights; `share` if a class is missing."""

    share: float
    means: tuple[np.ndarray, np.ndarray] | None = None
    whiten: tuple[np.ndarray, np.ndarray] | None = None
    offsets: tuple[float, float] | None = None

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        if self.means is None:
            return np.full(len(features), self.share)
        density = [
            offset - 0.5 * (((features - mean) @ white.T) ** 2).sum(1)
            for mean, white, offset in zip(self.means, self.whiten, self.offsets, strict=True)
        ]
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(labelled: DataFrame, shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Discriminant:
    """Learn from features and label (0 or 1). Counts, sums and products are added
    up by Spark; the driver gets one number per class and pair of features."""
    d = len(FEATURES)
    extended = F.concat(F.col("features"), F.array(F.lit(1.0)))
    cells = F.transform(
        F.sequence(F.lit(0), F.lit((d + 1) ** 2 - 1)),
        lambda k: F.element_at(F.col("x"), (k / (d + 1)).cast("int") + 1) * F.element_at(F.col("x"), k % (d + 1) + 1),
    )
    sums = (
        labelled.where(F.col("label").isin(0, 1))
        .select("label", extended.alias("x"))
        .select("label", F.posexplode(cells).alias("cell", "value"))
        .groupBy("label", "cell")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    moments = np.zeros((2, (d + 1) ** 2))
    for row in sums:
        moments[row["label"], row["cell"]] = row["value"]
    moments = moments.reshape(2, d + 1, d + 1)
    counts = moments[:, d, d]
    if counts.min() == 0:
        return Discriminant(float(counts[1] / counts.sum()) if counts.sum() else 0.5)
    means = moments[:, :d, d] / counts[:, None]
    covs = moments[:, :d, :d] / counts[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (covs * counts[:, None, None]).sum(0) / counts.sum()
    between = sum(c * np.outer(m, m) for c, m in zip(counts, means, strict=True)) / counts.sum()
    overall = counts @ means / counts.sum()
    scale = np.diag(pooled + between - np.outer(overall, overall)).clip(1e-6)
    whiten, offsets = [], []
    for k in (0, 1):
        part = min(1.0, shrinkage + d / (d + counts[k]))
        cov = (1 - part) * covs[k] + part * pooled + ridge * np.diag(scale)
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        offsets.append(float(np.log(counts[k] / counts.sum()) - np.log(np.diag(factor)).sum()))
    return Discriminant(
        float(counts[1] / counts.sum()), (means[0], means[1]), (whiten[0], whiten[1]), (offsets[0], offsets[1])
    )


def held_out(doc_id: Column) -> Column:
    """Rows that learning never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(features: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from all labelled rows of `features` outside the held-out part."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.col("quality").cast("int").alias("label")
    )
    return fit(features.join(known, "doc_id"))


def scored_by(model: Discriminant):
    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        rows = np.stack(features.to_list()) if len(features) else np.zeros((0, len(FEATURES)))
        return pd.Series(model.scores(rows))

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted. Texts are read once;
    the features are pinned, learned from and scored."""
    features = pinned(with_statistics(docs))
    model = train(features, labels)
    score = scored_by(model)
    return features.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("features").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject; columns as in `docs`.

    Texts are read twice, to learn and to score, and never shuffled: only the statistics
    of labelled documents are joined with their labels.
    """
    model = train(with_statistics(docs), labels)

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.stack([statistics(t) for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(model.scores(rows) >= 0.5))

    return docs.mapInArrow(accepted, docs.schema)
