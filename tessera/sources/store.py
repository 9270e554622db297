"""A store of versioned Parquet tables: write, then swap the version that readers see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


class Store:
    """Tables as folders v=N below root; a commit file names the current one, and old ones stay for undo.

    All access is by Spark's readers and the Hadoop file system, so root may be in any store.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self, table: str) -> list[int]:
        """Committed versions: those whose write ended."""
        fs, p = self._fs(f"{self.root}/{table}")
        if not fs.exists(p):
            return []
        found = []
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith("v=") and fs.exists(self._fs(f"{self.root}/{table}/{name}/_SUCCESS")[1]):
                found.append(int(name[2:]))
        return sorted(found)

    def exists(self, table: str) -> bool:
        return bool(self.versions(table))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        known = self.versions(table)
        if not known:
            return self.spark.createDataFrame([], schemas.struct(table))
        return self.spark.read.parquet(f"{self.root}/{table}/v={known[-1] if version is None else version}")

    def write(self, table: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        """A new version; readers of the old one are not disturbed, so df may read the table itself."""
        fs, p = self._fs(f"{self.root}/{table}")
        n = max((int(s.getPath().getName()[2:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v=")), default=-1) + 1 if fs.exists(p) else 0
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{table}/v={n}")
        return n

    def rollback(self, table: str) -> bool:
        """Drop the latest version; False if there is no earlier one."""
        known = self.versions(table)
        if len(known) < 2:
            return False
        fs, p = self._fs(f"{self.root}/{table}/v={known[-1]}")
        return fs.delete(p, True)

    def drop(self, table: str) -> bool:
        fs, p = self._fs(f"{self.root}/{table}")
        return fs.delete(p, True)

    def append_log(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").json(f"{self.root}/logs/{name}")

    def health(self) -> dict[str, bool]:
        return {t: self.exists(t) for t in schemas.SCHEMAS}


    def create(self, tables: tuple[str, ...] | None = None, recreate: bool = False) -> list[str]:
        """Empty tables with the schemas, where there are none; with recreate, instead of those there are."""
        made = []
        for t in tables or tuple(schemas.SCHEMAS):
            if recreate:
                self.drop(t)
            if not self.exists(t):
                self.write(t, self.spark.createDataFrame([], schemas.struct(t)))
                made.append(t)
        return made

    def set_status(self, document_id: str, status: str, error: str | None = None) -> None:
        """A document's step in ingestion: ingesting, completed or failed; a failed one loses its chunks."""
        if status not in ("ingesting", "completed", "failed"):
            raise ValueError(f"unknown status {status}")
        docs = self.read("documents")
        hit = F.col("document_id") == document_id
        self.write("documents", docs.withColumns({"ingestion_status": F.when(hit, status).otherwise(F.col("ingestion_status")), "ingestion_error": F.when(hit, F.lit(error)).otherwise(F.col("ingestion_error"))}))
        if status == "failed":
            for t in ("chunks", "chunk_vectors"):
                if self.exists(t):
                    self.write(t, self.read(t).filter(~hit))

    def record(self, event: str, payload: dict) -> None:
        """One line in the audit log."""
        import json

        row = self.spark.range(1).select(F.current_timestamp().alias("at"), F.lit(event).alias("event"), F.lit(json.dumps(payload)).alias("payload"))
        self.append_log("audit", row)

    def log(self, name: str, schema: str) -> DataFrame:
        fs, p = self._fs(f"{self.root}/logs/{name}")
        return self.spark.read.schema(schema).json(f"{self.root}/logs/{name}") if fs.exists(p) else self.spark.createDataFrame([], schema)


def by_key(table: DataFrame, key: str, columns: tuple[str, ...] = ("id", "candidate_key")) -> DataFrame:
    """Rows whose identifier, or candidate key, is the one asked for."""
    hit = F.lit(False)
    for c in columns:
        if c in table.columns:
            hit = hit | (F.col(c) == key)
    return table.filter(hit)


def by_ids(table: DataFrame, ids: DataFrame, column: str = "id", limit: int | None = None) -> DataFrame:
    rows = table.join(ids.select(column).distinct(), column, "left_semi")
    return rows if limit is None else rows.orderBy(column).limit(limit)


def by_name(table: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    hit = F.lower(F.trim("canonical_name")) == name.strip().lower()
    return table.filter(hit if kind is None else hit & (F.col("entity_type") == kind))


def chunks_of_document(chunks: DataFrame, document_id: str, level: int | None = None) -> DataFrame:
    rows = chunks.filter(F.col("document_id") == document_id)
    return (rows if level is None else rows.filter(F.col("level") == level)).orderBy("level", "hierarchy_path")


def chunks_for_entities(chunks: DataFrame, entity_ids: list[str], limit: int = 100) -> DataFrame:
    hit = chunks.filter(F.arrays_overlap("entity_ids", F.array(*map(F.lit, entity_ids)))).dropDuplicates(["chunk_id"])
    return hit.orderBy("level", "hierarchy_path", "chunk_id").limit(limit)


def sql(spark: SparkSession, query: str, **params) -> DataFrame:
    """Any parameterised query."""
    return spark.sql(query, args=params)
