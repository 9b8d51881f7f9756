"""Change lists and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions.text import fields

CHANGE_LINE = "line"


def read_change_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of change-list text files, with the folder columns of a partitioned layout."""
    return spark.read.text(path).withColumnRenamed("value", CHANGE_LINE)


def parse_change_lines(
    rows: DataFrame, line: str = CHANGE_LINE, tab_separated: bool = False
) -> DataFrame:
    """Status and path of change-list lines; lines with fewer than two fields are dropped.

    Fields end at any whitespace. With `tab_separated` they end at tabs only,
    which keeps paths that contain spaces.
    """
    parts: Column = (
        F.split(F.col(line), "\t", -1) if tab_separated else fields(F.col(line))
    )
    return (
        rows.where(F.size(parts) >= 2)
        .withColumns({"status": F.get(parts, F.lit(0)), "path": F.get(parts, F.lit(1))})
        .drop(line)
    )
