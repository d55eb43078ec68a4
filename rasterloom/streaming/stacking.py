"""Live stacking (an extension): running aggregates of pixels as frames arrive, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PIXELS = "frame_idx int, plane_idx int, y int, x int, v double, ts timestamp"


def arriving(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """Pixels of Parquet files that appear in a folder, a bounded number a trigger."""
    return spark.readStream.schema(PIXELS).option("maxFilesPerTrigger", files).parquet(path)


def live_stack(pixels: DataFrame) -> DataFrame:
    """Sum, count, extremes and mean of valid pixels per cell; the state is a row a cell, whatever the number of frames."""
    return pixels.groupBy("plane_idx", "y", "x").agg(F.sum("v").alias("sum"), F.count("v").alias("count"), F.min("v").alias("minimum"), F.max("v").alias("maximum"), F.avg("v").alias("average"))


def windowed_stack(pixels: DataFrame, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """The average per cell and time window; a watermark lets state of closed windows go."""
    return pixels.withWatermark("ts", late).groupBy(F.window("ts", length), "plane_idx", "y", "x").agg(F.avg("v").alias("average"), F.count("v").alias("count"))


def start(stack: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    return stack.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
