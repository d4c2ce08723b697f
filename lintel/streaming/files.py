"""Extension: findings of structured documents as they arrive. The batch query runs on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.rules import Rule, evaluate_documents


def document_stream(spark: SparkSession, path: str, most_files: int = 1_000) -> DataFrame:
    """(doc_id, body) of JSON files as they appear under a path."""
    return spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", most_files).load(path).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("body"))


def review_stream(documents: DataFrame, rules: list[Rule], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Findings of each document, once, appended as Parquet by micro-batch: a batch that runs again overwrites its own folder."""

    def each(frame: DataFrame, number: int) -> None:
        evaluate_documents(frame, rules).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = documents.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by event-time window, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
