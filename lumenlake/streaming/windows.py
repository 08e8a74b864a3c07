"""Structured Streaming over events: an extension, the reference has no streams. The functions take batch or stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def rates(events: DataFrame, size: str, late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, mean_value of tumbling windows; a stream drops what is later than `late`."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    found = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows as Parquet, exactly once; ends when the input that is there has been read."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
