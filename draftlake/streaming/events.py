"""Windowed counts over an event stream. An extension: the pipeline itself is batch only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.common import shared_folder, table


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """window_start, event_type, n, total: tumbling windows; events later than the watermark are dropped by a stream."""
    source = events.withColumn("ts", F.col("ts").cast("timestamp"))
    source = source.withWatermark("ts", late) if events.isStreaming else source
    grouped = source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "total")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there and return its result, which is written to the shared folder like its state."""
    folder = f"{shared_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    write = lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/result")
    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/result")
