"""Structured Streaming: new documents into the store, and metrics over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import ingestion
from ..sources import files, pdf
from ..sources.store import Store


def document_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Files that arrive below a folder."""
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).schema(
        "path string, modificationTime timestamp, length long, content binary"
    ).load(path)
    name = F.regexp_replace("path", "^file:/+", "/")
    return raw.select(name.alias("path"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), F.sha2("content", 256).alias("checksum"), "content", "modificationTime")


def ingest_stream(spark: SparkSession, path: str, store: Store, checkpoint: str, trigger: dict | None = None):
    """Each batch of new files goes through the same plan as a batch run: documents, chunks, vectors and candidates.

    A batch that is run again changes nothing. A batch writes a new version of the tables, so
    triggers should gather many files.
    """

    def batch(df: DataFrame, _epoch: int) -> None:
        ingestion.fold(store, files.read_documents(df, pdf.text))

    stream = document_stream(spark, path).withWatermark("modificationTime", "1 hour").dropDuplicatesWithinWatermark(["path", "checksum"])
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window; works on a stream and on a table."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
