"""Full-text search over an inverted index with BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tokens(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


BROADCAST_TOKENS = 100_000


def index(rows: DataFrame, id_col: str, text, wanted: DataFrame | None = None) -> DataFrame:
    """(token, id, tf, len); wanted (token) keeps the postings of these alone, before anything is shuffled if they are few."""
    t = rows.select(F.col(id_col).alias("id"), tokens(text).alias("ts")).select("id", F.size("ts").alias("len"), F.explode("ts").alias("token"))
    if wanted is not None:
        wanted = wanted.select("token").distinct()
        t = t.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_TOKENS else wanted, "token", "left_semi")
    return t.groupBy("token", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def lengths(rows: DataFrame, id_col: str, text) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.size(tokens(text)).alias("len"))


def asked_tokens(queries: DataFrame) -> DataFrame:
    """query_id, token: the words of each question, once."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))


def search_entities(entities: DataFrame, queries: DataFrame, limit: int = 10, types: list[str] | None = None, status: str | None = None, kind: str = "entity_type", id_col: str = "id") -> DataFrame:
    """query_id, id, score, rank: full-text search over names, aliases and descriptions of entities or candidates.

    Types and status filter the hits, not the statistics of the index.
    """
    from pyspark.sql import Window as W

    none = F.array().cast("array<string>")
    text = F.concat_ws(" ", "canonical_name", F.array_join(F.coalesce("aliases", none), " "), "description")
    found = bm25(index(entities, id_col, text, asked_tokens(queries)), lengths(entities, id_col, text), queries)
    keep = entities if types is None else entities.filter(F.col(kind).isin(*types))
    keep = keep if status is None else keep.filter(F.col("status") == status)
    hits = found.join(keep.select(F.col(id_col).alias("id")), "id", "left_semi")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query_id", "id", "score", "rank")


def palette(candidates: DataFrame, said: str, limit: int = 10) -> DataFrame:
    """The first candidates whose name or key holds what is typed, by name."""
    low = said.lower()
    hit = F.lower("canonical_name").contains(low) | F.lower("candidate_key").contains(low)
    return candidates.filter(hit).orderBy(F.lower("canonical_name"), "candidate_key").limit(limit)


def bm25(inverted: DataFrame, sizes: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id, score for queries (query_id, text); the query words meet the index in an equi-join.

    Postings of a frequent word are a skewed key, which the adaptive join splits.
    """
    stats = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    q = asked_tokens(queries)
    df = inverted.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    hits = inverted.join(q, "token").join(df, "token").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return hits.groupBy("query_id", "id").agg(F.sum(part).alias("score"))
