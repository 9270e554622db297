"""Vector search and similarity joins over array columns."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import similarity as S
from ..functions import text as X
from . import graph

BROADCAST_BYTES = 64 << 20
#: Vectors of a block; two blocks are compared in one task.
BLOCK = 2048


def payload_filter(points: DataFrame, document_ids: list | None = None, level: int | None = None, entity_ids: list | None = None, entity_types: list | None = None) -> DataFrame:
    """Points of any of the documents, of a level, about any of the entities, of any of the types; None means no filter."""
    if entity_types is not None:
        points = points.filter(F.col("entity_type").isin(*entity_types))
    if document_ids is not None:
        points = points.filter(F.col("document_id").isin(*document_ids))
    if level is not None:
        points = points.filter(F.col("level") == level)
    if entity_ids is not None:
        points = points.filter(F.arrays_overlap("entity_ids", F.array(*map(F.lit, entity_ids))))
    return points


def knn(points: DataFrame, queries: DataFrame, k: int = 20, least: float | None = 0.5, point_id: str = "id", query_id: str = "query_id", vec: str = "vec", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k most similar points of each query, exact: query_id, id, score, rank.

    A stated query set in blocks against all points. The queries go to the points if they
    are few, by their measured bytes; otherwise blocks of queries meet blocks of points in
    tasks of a bounded size, and each keeps k rows a query. Vectors of no length score 0.
    """
    p = points.select(F.col(point_id).alias("_id"), F.col(vec).alias("_v"), S.norm(F.col(vec)).alias("_pn"))
    q = queries.select(F.col(query_id).alias("_q"), F.col(vec).alias("_w"), S.norm(F.col(vec)).alias("_qn"))
    n, numbers = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_w")), F.lit(0))).first()
    if 8 * numbers <= broadcast_bytes:
        size = F.col("_pn") * F.col("_qn")
        score = F.when(size == 0, F.lit(0.0)).otherwise(S.dot(F.col("_v"), F.col("_w")) / size)
        out = p.crossJoin(F.broadcast(q)).select(F.col("_q").alias(query_id), F.col("_id").alias(point_id), score.alias("score"))
    else:
        out = _tiled(p, q, n, k).withColumnsRenamed({"_q": query_id, "_id": point_id})
    out = out if least is None else out.filter(F.col("score") >= least)
    rank = F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("score"), point_id))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def _tiled(p: DataFrame, q: DataFrame, n_queries: int, k: int) -> DataFrame:
    """_q, _id, score: the k best of each block of points for each query of each block of queries."""
    n_points = p.count()
    a, b = max(1, -(-n_points // BLOCK)), max(1, -(-n_queries // BLOCK))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = p.select(deal("_id", a).alias("i"), every(b).alias("j"), F.col("_id"), F.lit(None).cast(q.schema["_q"].dataType).alias("_q"), F.col("_v").cast("array<double>").alias("v"))
    right = q.select(every(a).alias("i"), deal("_q", b).alias("j"), F.lit(None).cast(p.schema["_id"].dataType).alias("_id"), "_q", F.col("_w").cast("array<double>").alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf["_q"].notna().to_numpy()
        out = {"_q": [], "_id": [], "score": []}
        if asked.any() and not asked.all():
            ids = pdf["_id"][~asked].to_numpy()
            scores = _unit(pdf["v"][asked]) @ _unit(pdf["v"][~asked]).T
            for query, row in zip(pdf["_q"][asked], np.round(scores, 12)):
                for i in np.lexsort((ids, -row))[:k]:
                    for c, x in zip(out.values(), (query, ids[i], row[i])):
                        c.append(x)
        return pd.DataFrame(out)

    kinds = dict(left.dtypes)
    return left.unionByName(right).groupBy("i", "j").applyInPandas(run, f"_q {kinds['_q']}, _id {kinds['_id']}, score double")


def _unit(vectors) -> np.ndarray:
    """Rows of length 1; those of no length stay zero."""
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(size == 0, 1, size)


def similar_pairs(points: DataFrame, threshold: float = 0.85, type_col: str = "entity_type", point_id: str = "id", vec: str = "vec", unknown: str = "UNKNOWN") -> DataFrame:
    """left < right of compatible types with cosine >= threshold, exact; a type that is unknown, or null, goes with any.

    Points of a type are dealt into blocks of about BLOCK vectors, and each two blocks of
    compatible types meet in one task, as two matrices. So a type's pairs are spread over
    many tasks, whatever its size, and no pair under the threshold leaves one. The work
    is quadratic in a type's points, as the operator asks for all pairs.
    """
    p = points.select(F.col(point_id).alias("_id"), F.col(type_col).alias("_t"), F.coalesce(F.col(type_col), F.lit(unknown)).alias("kind"), F.col(vec).cast("array<double>").alias("v"))
    sizes = p.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    p = p.join(F.broadcast(sizes), "kind").withColumn("block", F.pmod(F.xxhash64("_id"), F.col("blocks")).cast("int"))  # one row a type
    blocks = sizes.select("kind", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    a, b = blocks.select(F.col("kind").alias("ka"), F.col("block").alias("ba")), blocks.select(F.col("kind").alias("kb"), F.col("block").alias("bb"))
    same = a.join(b, (F.col("ka") == F.col("kb")) & (F.col("ba") <= F.col("bb")))
    wild = a.filter(F.col("ka") == unknown).join(b.filter(F.col("kb") != unknown), F.lit(True))
    tiles = same.unionByName(wild).withColumn("tile", F.concat_ws("|", "ka", "ba", "kb", "bb"))
    side = lambda k, b, n: tiles.select("tile", F.col(k).alias("kind"), F.col(b).alias("block"), F.lit(n).alias("side"))
    alone = (F.col("ka") == F.col("kb")) & (F.col("ba") == F.col("bb"))
    ends = side("ka", "ba", 0).unionByName(tiles.filter(~alone).select("tile", F.col("kb").alias("kind"), F.col("bb").alias("block"), F.lit(1).alias("side")))
    rows = p.join(ends, ["kind", "block"]).select("tile", "side", "_id", "_t", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf[pdf["side"] == 0]
        two = pdf[pdf["side"] == 1] if (pdf["side"] == 1).any() else one
        first, second = one["_id"].to_numpy(), two["_id"].to_numpy()
        left, right = _unit(one["v"]), _unit(two["v"])
        i, j = np.nonzero(left @ right.T >= threshold - 1e-9)
        if two is one:
            i, j = i[first[i] < second[j]], j[first[i] < second[j]]
        score = np.einsum("ij,ij->i", left[i], right[j])
        keep = score >= threshold
        i, j, score = i[keep], j[keep], score[keep]
        swap = first[i] > second[j]
        ta, tb = one["_t"].to_numpy(), two["_t"].to_numpy()
        pick = lambda x, y: np.where(swap, y, x)
        return pd.DataFrame({"left": pick(first[i], second[j]), "right": pick(second[j], first[i]), "lt": pick(ta[i], tb[j]), "rt": pick(tb[j], ta[i]), "similarity": score})

    kinds = dict(rows.dtypes)
    return rows.groupBy("tile").applyInPandas(run, f"left {kinds['_id']}, right {kinds['_id']}, lt {kinds['_t']}, rt {kinds['_t']}, similarity double")


def clusters(pairs: DataFrame, points: DataFrame, point_id: str = "id") -> DataFrame:
    """Components of the similarity graph with their representative: most mentions, longest description, longest name, first by id."""
    comp = graph.connected_components(pairs)
    rows = comp.join(points, comp["node"] == points[point_id])
    weight = F.struct((-F.col("mention_count")).alias("m"), (-F.length(F.coalesce("description", F.lit("")))).alias("d"), (-F.length("name")).alias("n"), F.col(point_id))
    reps = rows.groupBy("component").agg(F.min_by(point_id, weight).alias("representative"), F.count(F.lit(1)).alias("size"))
    return comp.join(reps, "component")


def merge_suggestions(pairs: DataFrame, members: DataFrame, points: DataFrame, point_id: str = "id") -> DataFrame:
    """Representative -> member with confidence .7 similarity + .2 type + .1 mentions; automatic from .95 with types aligned."""
    m = members.filter(F.col("node") != F.col("representative")).select("component", F.col("representative").alias("source"), F.col("node").alias("target"))
    both = pairs.select(F.col("left").alias("source"), F.col("right").alias("target"), "similarity", "lt", "rt").union(
        pairs.select(F.col("right"), F.col("left"), "similarity", F.col("rt"), F.col("lt"))
    )
    count = points.select(F.col(point_id).alias("_i"), F.col("mention_count").alias("_m"))
    rows = m.join(both, ["source", "target"])
    rows = rows.join(count.withColumnsRenamed({"_i": "source", "_m": "sm"}), "source").join(count.withColumnsRenamed({"_i": "target", "_m": "tm"}), "target")
    align = F.when(F.col("lt") == F.col("rt"), 1.0).when((F.col("lt") == "UNKNOWN") | (F.col("rt") == "UNKNOWN"), 0.5).otherwise(0.0)
    support = F.least(F.lit(1.0), F.log2(1.0 + F.least("sm", "tm")) / 5)
    conf = F.least(F.lit(1.0), 0.7 * F.col("similarity") + 0.2 * align + 0.1 * support)
    return rows.select("source", "target", "similarity", conf.alias("confidence"), ((F.col("similarity") >= 0.95) & (align >= 0.9)).alias("auto_merge"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _hashed(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    """Signed counts of hashed words, of length 1."""
    out, seen = [], {}
    for text, size in zip(texts, sizes):
        vec = np.zeros(size)
        for word in re.findall(r"\w+", (text or "").lower()):
            if word not in seen:
                if len(seen) > 200_000:
                    seen.clear()
                seen[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            h = seen[word]
            vec[h % size] += 1.0 if h >> 63 else -1.0
        norm = np.sqrt(vec @ vec)
        out.append((vec / norm if norm else vec).tolist())
    return pd.Series(out)


def hashed_embedding(text, size: int = 64):
    """Offline embedder: signed counts of hashed words, L2-normalised; deterministic, linear in the text."""
    return _hashed(F.coalesce(text, F.lit("")), F.lit(size))


def embed_cached(rows: DataFrame, text, cache: DataFrame | None = None, embed=hashed_embedding, max_tokens: int = 512) -> tuple[DataFrame, DataFrame]:
    """(rows with vec, cache): texts are cut at a word, keyed by MD5, and only those without a cached vector are embedded.

    The cache is a table (md5, vec); what is returned has the new vectors as well.
    """
    keyed = rows.withColumn("_cut", X.truncate_words(F.coalesce(text, F.lit("")), max_tokens)).withColumn("md5", F.md5("_cut"))
    known = cache.select("md5", "vec") if cache is not None else rows.sparkSession.createDataFrame([], "md5 string, vec array<double>")
    fresh = keyed.groupBy("md5").agg(F.min("_cut").alias("_cut")).join(known, "md5", "left_anti").select("md5", embed(F.col("_cut")).alias("vec"))
    full = known.unionByName(fresh.select("md5", F.col("vec").cast("array<double>").alias("vec")))
    return keyed.join(full, "md5").drop("_cut", "md5"), full


def cache_hits(rows: DataFrame, text, cache: DataFrame, max_tokens: int = 512) -> DataFrame:
    """texts, hits, hit_rate of looking texts up in an embedding cache."""
    keyed = rows.select(F.md5(X.truncate_words(F.coalesce(text, F.lit("")), max_tokens)).alias("md5"))
    hit = keyed.join(cache.select("md5", F.lit(1).alias("hit")).distinct(), "md5", "left")
    return hit.agg(F.count(F.lit(1)).alias("texts"), F.count("hit").alias("hits")).withColumn("hit_rate", F.when(F.col("texts") > 0, F.col("hits") / F.col("texts")).otherwise(0.0))


def backfill(entities: DataFrame, vectors: DataFrame | None, embed=hashed_embedding) -> DataFrame:
    """Vectors (id, vec) of all approved entities: those there are, and new ones for entities without."""
    todo = entities.filter("status = 'approved'")
    if vectors is not None:
        todo = todo.join(vectors.select("id"), "id", "left_anti")
    new = todo.select("id", embed(curated_text(F.col("canonical_name"), F.col("description"), F.col("aliases"))).cast("array<double>").alias("vec"))
    return new if vectors is None else vectors.select("id", "vec").unionByName(new)


def entity_text(name, aliases, description):
    """What is embedded of an entity for deduplication: name and three aliases with ' / ', then the description."""
    return F.concat_ws(" ", F.array_join(F.concat(F.array(name), F.slice(F.coalesce(aliases, F.array().cast("array<string>")), 1, 3)), " / "), F.nullif(description, F.lit("")))


def curated_text(name, description, aliases):
    """What is embedded of an approved entity: name, description and aliases, where there are any, with '. '."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(". ", some(name), some(description), some(F.array_join(F.coalesce(aliases, F.array().cast("array<string>")), ", ")))


def average_similarity(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """component, size, average over all pairs of its members; a pair that isn't listed counts as its floor of 0."""
    at = members.select(F.col("node").alias("left"), "component")
    total = pairs.join(at, "left").groupBy("component").agg(F.sum("similarity").alias("s"))
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    n = F.col("size") * (F.col("size") - 1) / 2
    return size.join(total, "component", "left").select("component", "size", F.when(n > 0, F.coalesce("s", F.lit(0.0)) / n).otherwise(1.0).alias("similarity"))


# ---------------------------------------------------------------- approximate index


def fit_cells(points: DataFrame, cells: int = 64, sample: int = 20_000, rounds: int = 8, vec: str = "vec", point_id: str = "id") -> np.ndarray:
    """Centres of an inverted index: spherical k-means over the `sample` points with the smallest hash (the bound of what is collected)."""
    rows = points.select(F.col(vec).cast("array<double>").alias("v"), F.xxhash64(point_id).alias("h")).orderBy("h").limit(sample).toPandas()
    if not len(rows):
        return np.zeros((0, 0))
    x = _unit(rows["v"])
    centres = x[: min(cells, len(x))].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                m = x[near == c].sum(axis=0)
                centres[c] = m / (np.sqrt(m @ m) or 1)
    return centres


def index_cells(points: DataFrame, centres: np.ndarray, vec: str = "vec") -> DataFrame:
    """points with the cell they belong to; every row is indexed. Write it partitioned by cell, and a search reads few."""
    return points.withColumn("cell", F.element_at(_nearest(centres, 1)(F.col(vec).cast("array<double>")), 1))


def _nearest(centres: np.ndarray, n: int):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.argsort(-(_unit(vectors) @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)))

    return run


def ann(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = 10, probes: int = 8, point_id: str = "id", query_id: str = "query_id", vec: str = "vec") -> DataFrame:
    """Approximate k nearest: exact scores within the `probes` cells nearest to each query.

    A cell's points and its queries are dealt into blocks of about BLOCK, whatever its size,
    and each two blocks meet in one task as matrices; k rows a query, by score, then id,
    leave it. The matrices only choose: what may be among the k is scored as by S.cosine.
    """
    p = indexed.select("cell", F.col(point_id).alias("_id"), F.col(vec).alias("_v"))
    q = queries.select(F.col(query_id).alias("_q"), F.col(vec).alias("_w"), F.explode(_nearest(centres, probes)(F.col(vec).cast("array<double>"))).alias("cell"))
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = F.broadcast(blocks(p, "a").join(blocks(q, "b"), "cell"))  # one row a cell
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = p.join(sizes, "cell").select("cell", deal("a", "_id", "_v").alias("i"), every("b").alias("j"), "_id", "_v")
    right = q.join(sizes, "cell").select("cell", every("a").alias("i"), deal("b", "_q", "_w").alias("j"), "_q", "_w")
    width = centres.shape[1]

    def run(points: pa.Table, asked: pa.Table) -> pa.Table:
        if not points.num_rows or not asked.num_rows:
            pi, qi, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        else:
            v, w = (pc.list_flatten(c).to_numpy().astype(np.float64).reshape(-1, width) for c in (points["_v"], asked["_w"]))
            pi, qi, score = _best(v, w, pc.rank(points["_id"], "ascending", null_placement="at_start", tiebreaker="first").to_numpy(), k)
        return pa.table({query_id: asked["_q"].take(pa.array(qi)), point_id: points["_id"].take(pa.array(pi)), "score": pa.array(score, from_pandas=False)})

    key = ["cell", "i", "j"]
    schema = T.StructType([T.StructField(query_id, q.schema["_q"].dataType), T.StructField(point_id, p.schema["_id"].dataType), T.StructField("score", T.DoubleType())])
    out = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)
    rank = F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("score"), point_id))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def _best(v: np.ndarray, w: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Point, query and cosine of the k best of the rows v for each of the rows w; equal scores by order.

    Scores add up in the order of S.dot, so that they don't depend on blocks and equal vectors tie.
    """
    vn, wn = (np.sqrt(_dots(m.T, m.T)) for m in (v, w))
    with np.errstate(invalid="ignore", over="ignore"):
        x, y = (m / np.where(n == 0, 1, n)[:, None] for m, n in ((v, vn), (w, wn)))
        found, step = [], max(1, (1 << 20) // len(v))  # scores at once, all of which copies of a vector may choose
        for at in range(0, len(w), step):
            near = y[at : at + step] @ x.T
            near[np.isnan(near)] = np.inf  # first, as in Spark's order
            least = np.partition(near, len(v) - k, axis=1)[:, len(v) - k, None] if k < len(v) else -np.inf
            qi, pi = np.nonzero(near >= least - 1e-9)
            qi += at
            both = vn[pi] * wn[qi]
            score = np.where(both == 0, 0.0, _dots(v.T, w.T, pi, qi) / np.where(both == 0, 1, both))
            by = np.lexsort((order[pi], np.where(np.isnan(score), -np.inf, -score), qi))
            qi, pi, score = qi[by], pi[by], score[by]
            keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
            found.append((pi[keep], qi[keep], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _dots(a: np.ndarray, b: np.ndarray, i=slice(None), j=slice(None)) -> np.ndarray:
    """Dot products of the columns i of a and j of b, term by term as S.dot adds them; no column is copied whole."""
    out = 0.0
    for x, y in zip(a, b):
        out = out + x[i] * y[j]
    return out


def vector_stats(points: DataFrame, vec: str = "vec") -> DataFrame:
    return points.agg(F.count(F.lit(1)).alias("points"), F.max(F.size(vec)).cast("long").alias("dimensions"))
