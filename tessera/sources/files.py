"""Scans of documents and rule files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..operators import chunking

TEXT_SUFFIXES = ("txt", "md", "markdown")


def scan_files(spark: SparkSession, path: str, text: bool = True) -> DataFrame:
    """path, suffix, checksum, content of documents below a folder, each once."""
    suffixes = ("pdf", *TEXT_SUFFIXES) if text else ("pdf",)
    glob = "*.{" + ",".join(x for s in suffixes for x in (s, s.upper())) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    name = F.regexp_replace("path", "^file:/+", "/")
    return files.select(name.alias("path"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), F.sha2("content", 256).alias("checksum"), "content").dropDuplicates(["path"])


def read_documents(files: DataFrame, pdf=None) -> DataFrame:
    """Documents table; a suffix without a reader leaves an error in the row. Bytes that are no UTF-8 become U+FFFD.

    pdf: column function from binary content to text, a plug-in where a PDF library is at hand.
    """
    is_text = F.col("suffix").isin(*TEXT_SUFFIXES)
    raw = F.when(is_text, F.make_valid_utf8(F.col("content").cast("string")))
    if pdf is not None:
        raw = raw.when(F.col("suffix") == "pdf", pdf(F.col("content")))
    told = lambda r: F.struct(  # noqa: E731  what follows from a text, which is a lambda's argument and so decoded once
        r.alias("raw_text"),
        F.when(is_text, F.sha2(r, 256)).otherwise(F.col("checksum")).alias("checksum"),
        chunking.infer_title(r, F.col("path")).alias("title"),
        version_of(r).alias("version"),
        date_of(r).alias("date"),
    )
    docs = files.select("path", "suffix", F.get(F.transform(F.array(raw), told), F.lit(0)).alias("d"))
    docs = docs.select(F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), F.col("path").alias("file_path"), "suffix", "d.*")
    error = F.when(F.col("raw_text").isNull(), F.concat(F.lit("no reader for ."), F.col("suffix")))
    return docs.select(schemas.uuid5(F.col("checksum")).alias("document_id"), "*", error.alias("error")).drop("suffix")


def pdf_metadata(info: DataFrame) -> DataFrame:
    """document_id, title, author, date, page_count, version of PDF info rows (document_id, info map, page_count, first_page).

    Blank entries count as missing; the date is that of creation, else of change, else what the first page says.
    """
    said = lambda k: F.nullif(F.trim(F.try_element_at("info", F.lit(k))), F.lit(""))
    date = F.coalesce(pdf_date(said("CreationDate")), pdf_date(said("ModDate")), date_of(F.col("first_page")))
    return info.select("document_id", said("Title").alias("title"), said("Author").alias("author"), date.alias("date"), "page_count", version_of(F.col("first_page")).alias("version"))


def _first(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def version_of(text: Column) -> Column:
    return _first(text, C.VERSION_PATTERNS)


def date_of(text: Column) -> Column:
    """ISO date of the first pattern whose match is a real date."""
    found = F.array(*[F.regexp_extract(text, p, 1) for p in C.DATE_PATTERNS])
    iso = lambda s: F.when(s.rlike(r"^\d{4}-"), s).otherwise(F.concat_ws("-", F.substring(s, 7, 4), F.substring(s, 1, 2), F.substring(s, 4, 2)))
    real = F.filter(F.transform(F.filter(found, lambda s: s != ""), iso), lambda s: s.try_cast("date").isNotNull())
    return F.get(real, F.lit(0))


def pdf_date(value: Column) -> Column:
    """`D:YYYYMMDD…` as an ISO date."""
    d = F.regexp_extract(value, r"^(?:D:)?(\d{8})", 1)
    return F.when(d != "", F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)))


def pdf_sections(items: DataFrame) -> DataFrame:
    """document_id, s, u, title, content from labelled items (document_id, pos, label, text), as gaps and islands."""
    from pyspark.sql import Window as W

    w = W.partitionBy("document_id").orderBy("pos")
    head = F.col("label").isin("title", "section_header")
    sub = F.col("label").isin("subtitle", "subsection_header")
    x = items.withColumn("s", F.sum(head.cast("int")).over(w))
    x = x.withColumn("u", F.sum(sub.cast("int")).over(W.partitionBy("document_id", "s").orderBy("pos"))).filter("s > 0")
    body = F.filter(F.array_sort(F.collect_list(F.struct("pos", "label", "text"))), lambda i: ~i["label"].isin("title", "section_header", "subtitle", "subsection_header"))
    return x.groupBy("document_id", "s", "u").agg(F.min_by("text", "pos").alias("title"), F.array_join(F.transform(body, lambda i: i["text"]), "\n").alias("content"))


TABLES, FIGURES = ("table",), ("figure", "picture", "image")


def pdf_elements(items: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Tables or figures with their position among those of the document, and what else the items tell (text, page)."""
    from pyspark.sql import Window as W

    return items.filter(F.col("label").isin(*labels)).withColumn("position", F.row_number().over(W.partitionBy("document_id").orderBy("pos")))


def error_streak(docs: DataFrame, order: str, most: int = 5) -> DataFrame:
    """Rows up to the one that makes `most` errors in a row, per batch; later ones aren't read."""
    from pyspark.sql import Window as W

    w = W.partitionBy("batch").orderBy(order)
    bad = F.col("error").isNotNull()
    island = F.sum((~bad).cast("int")).over(w)
    d = docs.withColumn("_i", island)
    run = F.sum(bad.cast("int")).over(W.partitionBy("batch", "_i").orderBy(order))
    d = d.withColumn("_r", run)
    stop = F.min(F.when(F.col("_r") >= most, F.col(order))).over(W.partitionBy("batch"))
    return d.withColumn("_s", stop).filter(F.col("_s").isNull() | (F.col(order) <= F.col("_s"))).drop("_i", "_r", "_s")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of (label, pattern); bad lines are left out."""
    raw = spark.read.schema("label string, pattern string, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    # Spark answers a scan of the corrupt record alone without parsing, so the other columns are asked for with it.
    return raw.filter(F.col("label").isNotNull() & F.col("pattern").isNotNull() & F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_yaml(path: str, defaults: dict | None = None, env: dict | None = None) -> dict:
    """Settings on the driver: environment over file over defaults, merged in depth."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return deep_merge(deep_merge(defaults or {}, yaml.safe_load(f) or {}), env or {})


def deep_merge(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def history_statistics(history: DataFrame) -> DataFrame:
    """intent, n, share in percent, mean confidence of logged questions."""
    by = history.groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.avg("intent_confidence").alias("mean_confidence"))
    return by.crossJoin(F.broadcast(history.agg(F.count(F.lit(1)).alias("all")))).select("intent", "n", (100.0 * F.col("n") / F.col("all")).alias("share"), "mean_confidence")


def query_history(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Logged questions, newest first."""
    schema = "query_id string, original_text string, intent string, intent_confidence double, entity_mentions array<string>, keywords array<string>, requires_graph_traversal boolean, timestamp timestamp"
    rows = spark.read.schema(schema).json(path).orderBy(F.desc("timestamp"), "query_id")
    return rows if limit is None else rows.limit(limit)
