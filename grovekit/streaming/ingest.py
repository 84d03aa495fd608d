"""Streaming ingestion: chunks arrive as files and entities are merged into a table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grovekit.operators.extraction import mentions


def chunk_stream(spark: SparkSession, folder: str, fmt: str = "parquet", schema: str = "hash_code string, text string", max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(folder)


def merge_mentions(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's entity counts to ``target/batch=N``.

    A batch that is run again overwrites its own folder, so results are exact
    after any failure; ``read_mentions`` sums the batches.
    """
    def one(batch: DataFrame, n: int) -> None:
        counts = mentions(batch).groupBy("entity_name").agg(F.count(F.lit(1)).alias("mentions"), F.min("source_id").alias("first_source"))
        counts.write.mode("overwrite").parquet(f"{target}/batch={n}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_mentions(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).groupBy("entity_name").agg(F.sum("mentions").alias("mentions"), F.min("first_source").alias("first_source"))


def windowed_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of timed rows by window and type; rows later than the watermark are left out when streaming."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
