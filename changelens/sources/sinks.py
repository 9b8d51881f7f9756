"""Report, test-file and baseline sinks.

Every sink writes one row per record in folders per repository. The rebalance
hint lets adaptive execution spread a very large repository over several tasks
and put small ones together, so neither huge nor tiny files result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.functions import paths


def write_json_report(rows: DataFrame, path: str) -> None:
    rows.hint("rebalance", "repo").write.mode("overwrite").partitionBy("repo").json(path)


def write_test_files(files: DataFrame, path: str) -> None:
    """Write (repo, path, content) rows; only the repositories that occur are replaced."""
    (
        files.select("repo", "path", "content")
        .hint("rebalance", "repo")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repo")
        .parquet(path)
    )


def functional_files(files: DataFrame) -> DataFrame:
    return files.where(paths.is_functional_test(F.col("path")))


def publish_functional_files(files: DataFrame, path: str, folder: str = "tests/auto-generated") -> None:
    """Write the functional test files, moved to the folder of the second location. Files of
    several pull requests (pr_id) get a folder each, so equal base names don't meet."""
    request = [F.col("pr_id").cast("string")] if "pr_id" in files.columns else []
    moved = F.concat_ws("/", F.lit(folder), *request, paths.base_name(F.col("path")))
    write_test_files(functional_files(files).withColumn("path", moved), path)


def has_functional_files(files: DataFrame) -> bool:
    return not functional_files(files).limit(1).isEmpty()


def append_baselines(baselines: DataFrame, path: str) -> None:
    """Add (repo, ts, run_id, coverage) rows; the newest one before a run is its baseline."""
    baselines.select("repo", "ts", "run_id", "coverage").write.mode("append").parquet(path)


def newest_baselines(baselines: DataFrame) -> DataFrame:
    """The newest baseline per repository; of equal times, that of the largest run_id."""
    return baselines.groupBy("repo").agg(F.max_by("coverage", F.struct("ts", "run_id")).alias("coverage"))
