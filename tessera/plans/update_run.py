"""The update run: what changed below a folder, and the store brought up to date with it."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import update as U
from ..sources import files, pdf
from ..sources.store import Store
from . import ingestion


def update(spark: SparkSession, path: str, store: Store, dry_run: bool = False) -> dict[str, int]:
    """Deleted documents go with their chunks, renamed ones keep theirs, modified and new ones are ingested.

    Returns how many there are of each; with dry_run nothing is written.
    """
    scan = files.read_documents(files.scan_files(spark, path), pdf.text).select(F.col("file_path").alias("path"), "checksum")
    catalog = store.read("documents").withColumn("id", F.col("document_id"))
    roots = [path.rstrip("/")]
    changes = G.written(U.detect_changes(scan, U.in_scope(catalog, roots), roots), "changes")
    counts = {s: 0 for s in ("unchanged", "new", "modified", "renamed", "deleted")} | {r["status"]: r["n"] for r in changes.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    if dry_run:
        return counts
    kept, chunks, work = U.apply_changes(catalog, store.read("chunks"), changes)
    vectors = U.apply_changes(catalog, store.read("chunk_vectors"), changes)[1]
    kept, chunks, vectors = G.written(kept.drop("id"), "kept"), G.written(chunks, "chunks"), G.written(vectors, "vectors")
    store.write("documents", kept)
    store.write("chunks", chunks)
    store.write("chunk_vectors", vectors)
    if not work.isEmpty():
        ingestion.ingest(spark, path, store)
    return counts
