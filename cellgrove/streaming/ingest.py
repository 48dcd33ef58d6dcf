"""Incremental ingest of files, windowed counts and running means by pixel: streams that drain what is there and stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_new(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Append the rows of files not seen before to target; the checkpoint remembers which were."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The batch form: rows whose key is not done yet."""
    return rows.join(done.select(key), key, "left_anti")


def windowed_counts(spark: SparkSession, source: str, target: str, checkpoint: str, window: str = "1 hour", late: str = "2 hours") -> None:
    """Counts and mean value by event type and time window; windows close when the watermark passes them."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source).withWatermark("ts", late)
    counts = stream.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    query = counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()


def ingest_by_batch(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Write every micro-batch to a folder of its number, replacing it: a batch that runs again leaves its rows once."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def running_means(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """row, col, mean and scenes of all valid values (dn > 0) seen so far, as one table that every batch replaces.

    Sums and counts by pixel are the stream's state; a further call goes on from the checkpoint.
    """
    schema = spark.read.parquet(source).schema
    seen = spark.readStream.schema(schema).parquet(source).where("dn > 0")
    means = seen.groupBy("row", "col").agg(F.avg("dn").alias("mean"), F.count("*").alias("scenes"))

    def put(batch: DataFrame, _number: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    means.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
