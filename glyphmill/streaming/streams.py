"""Structured Streaming: documents from a folder, heartbeats of jobs, windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from glyphmill.plans.ingest import document_chunks, parse_documents
from glyphmill.sources.files import FILE_SCHEMA, decoded, digest


def file_stream(spark: SparkSession, root: str, source_id: str, glob: str = "*.md", files_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as (doc_id, source_id, rel_path, file_name, sha1, text), as they appear."""
    rows = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(root)
    )
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(
        F.xxhash64(F.lit(source_id), "path").alias("doc_id"), F.lit(source_id).alias("source_id"), F.col("path").alias("rel_path"),
        name.alias("file_name"), digest(F.col("content")).alias("sha1"), decoded(F.col("content")).alias("text"),
    )


def ingest_stream(files: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Parse, clean and chunk what is there now, hand (documents, chunks, batch id) to ``sink``, and stop.

    ``sink`` must be idempotent per batch id: after a failure a batch is given again.
    """

    def batch(rows: DataFrame, number: int) -> None:
        docs = parse_documents(rows).persist()
        try:
            sink(docs, document_chunks(docs), number)
        finally:
            docs.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """(start, event_type, n) per tumbling window; rows later than ``late`` are dropped when streaming."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(key, start, end, n) of runs of events no more than ``gap`` apart."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    grouped = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unique_events(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Events once per key; on a stream within the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])
