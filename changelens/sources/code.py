"""Source files: directories of text files and tables of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions import paths

CODE_SCHEMA = "repo STRING, path STRING, content STRING"


def read_source_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """One row (path, content) per file below a directory, paths relative to it."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return raw.select(
        paths.relative_to(full, root.removeprefix("file:")).alias("path"),
        F.col("value").alias("content"),
    )


def read_test_files(spark: SparkSession, root: str) -> DataFrame:
    """The test files below a directory."""
    return read_source_files(spark, root).where(paths.is_test_file(F.col("path")))


def write_code_table(files: DataFrame, path: str) -> None:
    """Snapshot table, one folder per repository.

    The rebalance hint lets adaptive execution split a repository that is much
    larger than the others over several tasks and files.
    """
    files.hint("rebalance", "repo").write.mode("overwrite").partitionBy("repo").parquet(path)


def read_code_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CODE_SCHEMA).parquet(path).select("repo", "path", "content")
