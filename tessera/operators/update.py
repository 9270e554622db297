"""Change detection between a scan of files and the catalog, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import candidates as K


def in_scope(catalog: DataFrame, roots: list[str] | None) -> DataFrame:
    if roots is None:
        return catalog
    hit = F.lit(False)
    for r in roots:
        hit = hit | F.col("file_path").startswith(r.rstrip("/") + "/") | (F.col("file_path") == r)
    return catalog.filter(hit)


def detect_changes(scan: DataFrame, catalog: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """path, checksum, status, document_id, last_ingested_at, old_path.

    Paths that match are unchanged or modified by checksum. What is left on either side is
    paired by checksum, first by path with first by path, as renamed; the rest is new or,
    within the scanned roots, deleted. No order of the scan matters.
    """
    s = scan.select("path", "checksum").dropDuplicates(["path"])
    c = catalog.select(F.col("id").alias("document_id"), F.col("file_path").alias("old_path"), F.col("checksum").alias("old_sum"), "last_ingested_at")
    j = s.join(c, s["path"] == c["old_path"], "full_outer")
    both = F.col("path").isNotNull() & F.col("old_path").isNotNull()
    same = j.filter(both).select("path", "checksum", F.when(F.col("checksum") == F.col("old_sum"), "unchanged").otherwise("modified").alias("status"), "document_id", "last_ingested_at", F.lit(None).cast("string").alias("old_path"))
    n = lambda by, order: F.row_number().over(W.partitionBy(by).orderBy(order))
    new = j.filter("old_path is null").select("path", "checksum").withColumn("n", n("checksum", "path"))
    gone = j.filter("path is null").select("document_id", "old_path", F.col("old_sum").alias("checksum"), "last_ingested_at").withColumn("n", n("checksum", "old_path"))
    pair = new.join(gone, ["checksum", "n"], "full_outer")
    status = F.when(F.col("path").isNotNull() & F.col("old_path").isNotNull(), "renamed").when(F.col("path").isNotNull(), "new").otherwise("deleted")
    rest = pair.withColumn("status", status)
    if roots is not None:
        keep = in_scope(rest.filter("status = 'deleted'").withColumn("file_path", F.col("old_path")), roots).drop("file_path")
        rest = rest.filter("status <> 'deleted'").unionByName(keep)
    rest = rest.select(F.coalesce("path", "old_path").alias("path"), "checksum", "status", "document_id", "last_ingested_at", F.when(F.col("status") == "renamed", F.col("old_path")).alias("old_path"))
    return same.unionByName(rest)


def apply_changes(catalog: DataFrame, chunks: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalog, chunks, work): deleted and modified documents lose their chunks, renamed ones keep them, work is what to ingest."""
    gone = changes.filter(F.col("status").isin("deleted", "modified")).select(F.col("document_id"))
    left = K.delete_keys(chunks, gone, "document_id").select(*chunks.columns)
    renamed = changes.filter("status = 'renamed'").select(F.col("document_id").alias("_d"), F.col("path").alias("_p"))
    dead = changes.filter("status = 'deleted'").select(F.col("document_id").alias("id"))
    cat = K.delete_keys(catalog, dead, "id").select(*catalog.columns).join(renamed, F.col("id") == F.col("_d"), "left")
    cat = cat.withColumn("file_path", F.coalesce("_p", "file_path")).drop("_d", "_p")
    return cat, left, changes.filter(F.col("status").isin("new", "modified")).select("path", "checksum", "document_id")


def to_ingest(incoming: DataFrame, catalog: DataFrame, force: bool = False) -> DataFrame:
    """Documents not yet completed with the same checksum."""
    if force:
        return incoming
    done = catalog.filter(F.col("ingestion_status") == "completed").select(F.col("id").alias("document_id"), "checksum")
    return incoming.join(done, ["document_id", "checksum"], "left_anti")


def outdated(incoming: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog ids whose file is now another document."""
    j = catalog.join(incoming.select(F.col("document_id").alias("_n"), F.col("file_path").alias("_p")), F.col("file_path") == F.col("_p"))
    return j.filter(F.col("id") != F.col("_n")).select("id").distinct()
