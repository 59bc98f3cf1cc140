"""Streams of landed papers: late duplicates dropped, windowed counts, upserts by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, schema, time: str, late: str = "7 days", key: str | None = None) -> DataFrame:
    """Rows as they land; a key seen again within the watermark is dropped."""
    rows = spark.readStream.schema(schema).parquet(folder).withWatermark(time, late)
    return rows.dropDuplicatesWithinWatermark([key]) if key else rows


def windowed(rows: DataFrame, time: str, every: str = "30 days", *keys: str) -> DataFrame:
    """Counts in tumbling windows."""
    out = rows.groupBy(F.window(time, every), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, "n")


def drain(df: DataFrame, folder: str, state: str, mode: str = "append") -> None:
    """Write what is there to Parquet and stop; the checkpoint folder lets the next call go on from there."""
    df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
