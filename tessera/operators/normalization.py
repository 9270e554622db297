"""The normalisation table: versioned mapping of raw names to canonical ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import struct


def variants(text):
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, r"\|"), lambda v: F.trim(v)), lambda v: v != "")))


def upsert(existing: DataFrame | None, entries: DataFrame) -> DataFrame:
    """Version +1 on an update; variants united and sorted; newer names, confidence and status; notes kept where the new are blank.

    Of several entries for one form the one with the latest updated_at counts.
    """
    last = entries.groupBy("normalized_form").agg(
        F.max_by(F.struct(*[c for c in entries.columns if c not in ("normalized_form", "raw_variants")]), F.struct("updated_at", F.xxhash64("canonical_name"))).alias("r"),
        F.array_distinct(F.flatten(F.collect_list("raw_variants"))).alias("raw_variants"),
    )
    new = last.select("normalized_form", "raw_variants", "r.*")
    if existing is None:
        return new.withColumn("raw_variants", F.array_sort("raw_variants")).withColumn("version", F.lit(1))
    o, n = existing.alias("o"), new.alias("n")
    j = o.join(n, "normalized_form", "full_outer")
    fresh = F.col("n.canonical_name").isNotNull()
    none = F.array().cast("array<string>")
    cols = [F.col("normalized_form")]
    for c in existing.columns:
        if c == "normalized_form":
            continue
        if c == "raw_variants":
            v = F.array_sort(F.array_union(F.coalesce("o.raw_variants", none), F.coalesce("n.raw_variants", none)))
        elif c == "version":
            v = F.when(~fresh, F.col("o.version")).otherwise(F.coalesce("o.version", F.lit(0)) + 1)
        elif c == "created_at":
            v = F.coalesce("o.created_at", "n.created_at")
        elif c == "notes":
            v = F.coalesce(F.nullif("n.notes", F.lit("")), "o.notes")
        else:
            v = F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        cols.append(v.alias(c))
    return j.select(*cols)


def remove(table: DataFrame, forms: DataFrame) -> DataFrame:
    return table.join(forms.select("normalized_form").distinct(), "normalized_form", "left_anti").select(*table.columns)


def lookup(names: DataFrame, table: DataFrame, normalized, columns: tuple[str, ...] = ("canonical_id", "canonical_name", "entity_type", "confidence", "status")) -> DataFrame:
    return names.withColumn("normalized_form", normalized).join(table.select("normalized_form", *columns), "normalized_form", "left")


def queue(table: DataFrame, least: float | None = None, kind: str | None = None, status: str | None = None, method: str | None = None, sort: str = "confidence", limit: int = 50) -> DataFrame:
    for c, v in (("entity_type", kind), ("status", status), ("method", method)):
        if v is not None:
            table = table.filter(F.col(c) == v)
    if least is not None:
        table = table.filter(F.col("confidence") >= least)
    order = {"confidence": [F.desc("confidence"), "updated_at"], "updated": [F.desc("updated_at")], "name": [F.lower("canonical_name")]}[sort]
    return table.orderBy(*order, "normalized_form").limit(limit)


def search(table: DataFrame, term: str) -> DataFrame:
    low = term.lower()
    hit = F.lower("canonical_name").contains(low) | F.col("normalized_form").contains(low) | F.exists("raw_variants", lambda v: F.contains(F.lower(v), F.lit(low)))
    return table.filter(hit)


def statistics(table: DataFrame) -> DataFrame:
    parts = [table.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("section"), "name", "n") for c in ("status", "method", "entity_type")]
    return parts[0].union(parts[1]).union(parts[2])


def to_csv_rows(table: DataFrame) -> DataFrame:
    return table.select(
        "normalized_form", F.array_join("raw_variants", " | ").alias("raw_variants"), "canonical_id", "canonical_name", "entity_type", "method",
        F.format_string("%.3f", "confidence").alias("confidence"), "version", "created_at", "updated_at", "notes", "source", "status",
    )


def export_csv(table: DataFrame, path: str) -> None:
    to_csv_rows(table).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def import_csv(spark, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    return raw.select(
        "normalized_form", variants(F.col("raw_variants")).alias("raw_variants"), "canonical_id", "canonical_name", "entity_type", "method",
        F.col("confidence").try_cast("double").alias("confidence"), F.col("version").try_cast("int").alias("version"),
        F.col("created_at").try_cast("timestamp").alias("created_at"), F.col("updated_at").try_cast("timestamp").alias("updated_at"), "notes", "source", "status",
    )


def export_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def import_json(spark, path: str) -> DataFrame:
    return spark.read.schema(struct("normalization")).json(path)
