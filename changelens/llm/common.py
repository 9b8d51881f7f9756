"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.session import pinned, work_path

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

__all__ = ["SPACE", "WORD", "docs_of", "hash_fraction", "let", "pinned", "slices", "table", "word_count", "work_path"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null. One character is kept per word."""
    marks = F.translate(F.regexp_replace(text, rf"[{SPACE}]*{WORD}", "x"), " \t\n\x0b\f\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def hash_fraction(seed: str, key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key only (52 bits of an MD5)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def docs_of(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns can't clash with derived ones."""
    return docs.select(*[docs[c] for c in columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what a task derives from a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
