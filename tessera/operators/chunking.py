"""Sections of Markdown text and the four-level chunk hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X


def infer_title(text: Column, path: Column) -> Column:
    """First `# ` heading of Markdown (which PDF text is read as), else the first line that isn't blank (200 characters), else the file's stem."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    heading = F.when(F.lower(path).rlike(r"\.(md|markdown|pdf)$"), F.trim(F.regexp_extract(text, r"(?m)^\s*# (.*)$", 1)))
    line = F.substring(F.trim(F.regexp_extract(text, r"(?m)^[^\S\n]*(\S[^\n]*)$", 1)), 1, 200)
    return F.coalesce(F.nullif(heading, F.lit("")), F.nullif(line, F.lit("")), stem)


def sections(docs: DataFrame, id_col: str = "document_id", text_col: str = "raw_text", path_col: str = "file_path") -> DataFrame:
    """document_id, h1, h2, title, content: `# ` opens a section, `## ` a subsection (h2 > 0).

    Text before the first heading is dropped; a `## ` before any `# ` opens a section named
    after the file. Lines are numbered per document, so the running counts are exact.
    """
    lines = docs.select(F.col(id_col).alias("document_id"), F.col(path_col).alias("path"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    w = W.partitionBy("document_id").orderBy("pos")
    is1, is2 = F.col("line").startswith("# "), F.col("line").startswith("## ")
    lines = lines.withColumn("seen1", F.sum(is1.cast("int")).over(w)).withColumn("any2", F.sum(is2.cast("int")).over(w))
    stray = F.max(F.when(is2 & (F.col("seen1") == 0), 1).otherwise(0)).over(W.partitionBy("document_id"))
    lines = lines.withColumn("stray", stray).withColumn("h1", F.when((F.col("seen1") == 0) & (F.col("any2") > 0), 1).otherwise(F.col("seen1") + F.when(F.col("seen1") > 0, F.col("stray")).otherwise(0)))
    lines = lines.filter("h1 > 0")
    lines = lines.withColumn("h2", F.sum(is2.cast("int")).over(W.partitionBy("document_id", "h1").orderBy("pos")))
    named = lines.filter("stray = 1 and h1 = 1").groupBy("document_id").agg(F.min("path").alias("path"))
    named = named.select("document_id", "path", F.lit(-1).alias("pos"), F.lit("").alias("line"), F.lit(1).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))
    lines = lines.select("document_id", "path", "pos", "line", "h1", "h2").unionByName(named)
    body = F.filter(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: ~(s["line"].startswith("# ") | s["line"].startswith("## ")))
    text = F.trim(F.array_join(F.transform(body, lambda s: F.rtrim(s["line"])), "\n"))
    head = F.min_by("line", "pos")
    stem = F.regexp_extract(F.min("path"), r"([^/]*?)(?:\.[^./]*)?$", 1)
    title = F.when(F.col("h2") > 0, F.trim(F.regexp_replace(head, "^## ", ""))).when(head.startswith("# "), F.trim(F.regexp_replace(head, "^# ", ""))).otherwise(stem)
    out = lines.groupBy("document_id", "h1", "h2").agg(title.alias("title"), F.regexp_replace(text, r"^\s+|\s+\z", "").alias("content"))
    return out


def pack_sentences(text: Column, max_tokens: int = 512) -> Column:
    """array of struct(content, token_count): sentences up to a budget of tokens, the last two carried over.

    The reset depends on the running sum, so it is a fold over the sentences' sizes, which
    puts out the bounds of each chunk; only then are sentences joined. Linear in the text.
    """
    def packed(said: Column) -> Column:
        sizes = F.transform(said, X.token_estimate)
        return F.get(F.transform(F.array(sizes), lambda n: _cut(said, n, max_tokens)), F.lit(0))

    said = F.filter(X.sentences(text), lambda s: F.trim(s) != "")
    return F.get(F.transform(F.array(said), packed), F.lit(0))  # lambdas' arguments are computed once


def _cut(said: Column, sizes: Column, max_tokens: int) -> Column:
    span = "array<struct<a:int,z:int,n:bigint>>"
    start = F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("n"), F.array().cast(span).alias("out"))
    chunk = lambda a, z, n: F.array(F.struct(a.alias("a"), z.alias("z"), n.alias("n")))

    def step(state: Column, i: Column) -> Column:
        size = F.get(sizes, i)
        full = (state["n"] + size > max_tokens) & (i > state["a"])
        first = F.greatest(state["a"], i - 2)  # the last two are carried over
        carried = F.when(i - 2 >= state["a"], F.get(sizes, i - 2)).otherwise(F.lit(0).cast("long")) + F.get(sizes, i - 1)
        return F.struct(
            F.when(full, first).otherwise(state["a"]).alias("a"),
            (F.when(full, carried).otherwise(state["n"]) + size).alias("n"),
            F.when(full, F.concat(state["out"], chunk(state["a"], i, state["n"]))).otherwise(state["out"]).alias("out"),
        )

    last = F.size(said)
    all_of = F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0)))
    spans = F.aggregate(all_of, start, step, lambda s: F.concat(s["out"], chunk(s["a"], last, s["n"])))
    texts = F.transform(spans, lambda s: F.struct(F.array_join(F.slice(said, s["a"] + 1, s["z"] - s["a"]), " ").alias("content"), s["n"].alias("token_count")))
    return F.when(last > 0, texts).otherwise(F.array().cast("array<struct<content:string,token_count:bigint>>"))


def _row(df: DataFrame, level: int, path: Column, parent: Column, title: Column, content: Column, tokens: Column | None = None) -> DataFrame:
    doc = F.col("document_id")
    return df.select(
        schemas.chunk_id(doc, F.lit(level), path).alias("chunk_id"), "document_id", F.lit(level).alias("level"), parent.alias("parent_chunk_id"),
        path.alias("hierarchy_path"), title.alias("section_title"), content.alias("content"), (X.token_estimate(content) if tokens is None else tokens).alias("token_count"),
    )


def paragraph_chunks(parents: DataFrame, max_tokens: int = 512, min_chars: int = 100) -> DataFrame:
    """Level 4: paragraphs of at least min_chars characters; long ones packed by sentences."""
    each = parents.select("document_id", F.col("chunk_id").alias("parent"), F.col("hierarchy_path").alias("path"), F.col("section_title").alias("title"), F.posexplode(X.paragraphs(F.col("content"))).alias("p", "raw"))
    each = each.withColumn("text", F.trim("raw")).filter(F.char_length("text") >= min_chars)
    base = F.concat_ws(".", F.nullif("path", F.lit("")), (F.col("p") + 1).cast("string"))
    short = _row(each.filter(X.token_estimate(F.col("text")) <= max_tokens), 4, base, F.col("parent"), F.col("title"), F.col("text"))
    long = each.filter(X.token_estimate(F.col("text")) > max_tokens).select("*", F.posexplode(pack_sentences(F.col("text"), max_tokens)).alias("k", "c"))
    packed = _row(long, 4, F.concat_ws(".", base, (F.col("k") + 1).cast("string")), F.col("parent"), F.col("title"), F.col("c.content"), F.col("c.token_count"))
    return short.unionByName(packed)


def chunk_documents(docs: DataFrame, max_tokens: int = 512, min_chars: int = 100, id_col: str = "document_id", text_col: str = "raw_text", path_col: str = "file_path") -> DataFrame:
    """Levels 1 to 4: document, sections, subsections, paragraphs. A document without headings goes to paragraphs at once."""
    base = docs.select(F.col(id_col).alias("document_id"), F.col(text_col).alias("raw_text"), F.col(path_col).alias("file_path"))
    secs = sections(base, "document_id", "raw_text", "file_path")
    title = infer_title(F.col("raw_text"), F.col("file_path"))
    top = _row(base, 1, F.lit(""), F.lit(None).cast("string"), title, F.col("raw_text"))
    path1 = F.col("h1").cast("string")
    path2 = F.concat_ws(".", path1, F.col("h2").cast("string"))
    root = schemas.chunk_id(F.col("document_id"), F.lit(1), F.lit(""))
    l2 = _row(secs.filter("h2 = 0"), 2, path1, root, F.col("title"), F.col("content"))
    l3 = _row(secs.filter("h2 > 0"), 3, path2, schemas.chunk_id(F.col("document_id"), F.lit(2), path1), F.col("title"), F.col("content"))
    plain = top.join(secs.select("document_id").distinct(), "document_id", "left_anti").select(*top.columns)
    with_subs = secs.filter("h2 > 0").select("document_id", path1.alias("hierarchy_path")).distinct()
    leaf2 = l2.join(with_subs, ["document_id", "hierarchy_path"], "left_anti").select(*l2.columns)
    l4 = paragraph_chunks(plain.unionByName(leaf2).unionByName(l3), max_tokens, min_chars)
    return top.unionByName(l2).unionByName(l3).unionByName(l4)


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    level = [F.count_if(F.col("level") == i).alias(f"level_{i}") for i in range(1, 5)]
    return chunks.agg(
        F.count(F.lit(1)).alias("total"), *level, F.round(F.avg("token_count"), 4).alias("avg_tokens"), F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"), F.sum("token_count").alias("total_tokens"),
    )


def extraction_chunks(chunks: DataFrame, order: tuple[int, ...] = (3, 2, 4, 1)) -> DataFrame:
    """Per document the chunks of the first level in `order` that it has."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("level"))
    best = F.min(place).over(W.partitionBy("document_id"))
    return chunks.withColumn("_b", best).withColumn("_p", place).filter("_p = _b").drop("_b", "_p")
