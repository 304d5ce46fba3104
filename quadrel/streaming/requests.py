"""Streams of tile requests: an extension, as the library's sources are at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, layer string, z int, x long, y long"


def read(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of request logs in Parquet files."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests for each layer in each hour; works on a stream and at rest."""
    return requests.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "layer").agg(F.count(F.lit(1)).alias("n"))


def distinct_tiles(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first request of each tile within the watermark: what a renderer has to do."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["layer", "z", "x", "y"])


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Append a stream to Parquet, exactly once by its checkpoint; runs until its input is used up."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)
