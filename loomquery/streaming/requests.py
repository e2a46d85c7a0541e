"""Requests as a stream: the first copy of each within a time window passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_requests(events: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Drop repeats of a request that come within ``delay``; state older than that is forgotten."""
    return events.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", delay).dropDuplicatesWithinWatermark(keys).drop("__time")


def windowed_totals(events: DataFrame, time: str, width: str, key: str, value: str, delay: str) -> DataFrame:
    """Count and sum by key in tumbling windows; late rows within ``delay`` are counted."""
    timed = events.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", delay)
    return timed.groupBy(F.window("__time", width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def run_to_end(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that is there as Parquet, exactly once across restarts, and stop."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
