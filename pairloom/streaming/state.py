"""Decision log as a stream: the same state as the batch operator gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def count_events(spark: SparkSession, path: str, name: str, checkpoint: str) -> DataFrame:
    """Counts by event type over all files under path, by a stream that ends when all is read."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
