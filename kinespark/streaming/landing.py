"""New tracking documents as they land: each holds a whole video, so a micro-batch is scored like a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinespark.sources.tracking import normalised, records


def stream_documents(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, text) of files that appear below path."""
    return spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def land_tracks(documents: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Gives each batch's normalised points to sink(points, batch id). A batch that is repeated after a failure has the same
    id, so a sink that overwrites by id counts it once."""
    points = normalised(records(documents))
    return points.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in windows of event time; later rows than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
