"""Frames and measurements that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from osseo.sources.files import frames


def incoming_frames(spark: SparkSession, root: str) -> DataFrame:
    """A stream of frame rows for the files that appear below root."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)
    return frames(files)


def windowed_measurements(stream: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Number and mean of a measurement per key and time window; rows later than ``late`` are dropped by the watermark."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width).alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), key, "n", "mean")
