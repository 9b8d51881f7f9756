"""React to pull-request events, once per event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from changelens.functions import fixed


def read_events(
    spark: SparkSession, folder: str, schema: str | StructType, glob: str = "*.parquet"
) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def run_requests(
    events: DataFrame,
    kinds: tuple[str, ...] = fixed.RUN_EVENT_KINDS,
    delay: str = "1 hour",
) -> DataFrame:
    """Events (event_id, ts TIMESTAMP, kind, ...) that start a run, repeats dropped.

    The watermark bounds the state: an id is remembered for `delay` only.
    """
    return (
        events.where(F.col("kind").isin(*kinds))
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["event_id"])
    )


def start_runs(requests: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append run requests to a table and stop when the input is used up."""
    return (
        requests.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
