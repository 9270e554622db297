"""Vector search, score handling and hybrid retrieval over `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import vectors as V
from .registry import query, table

COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def points(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("level"), F.concat(F.lit("T"), F.col("label").cast("string")).alias("entity_type"))


def asked(spark, sf, every=50):
    return points(spark, sf).filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vec")


def shown(df):
    return df.withColumn("score", F.round("score", 5))


def knn_sql(where_q: str, k: int, where_p: str = "true") -> str:
    return f"""
    SELECT query_id, id, round(s, 5) AS score, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank FROM (
        SELECT q.vec_id AS query_id, p.vec_id AS id, {COS.format(a='q.embedding', b='p.embedding')} AS s
        FROM embeddings q, embeddings p WHERE {where_q} AND {where_p}))
    WHERE rank <= {k}"""


@query(knn_sql("q.vec_id % 50 = 0", 20))
def knn_topk(spark, sf):
    return shown(V.knn(points(spark, sf), asked(spark, sf), k=20, least=None))


@query(knn_sql("q.vec_id % 50 = 0", 20, "p.label = 3"))
def knn_filtered(spark, sf):
    return shown(V.knn(V.payload_filter(points(spark, sf), level=3), asked(spark, sf), k=20, least=None))


@query(knn_sql("q.vec_id % 50 = 0", 10))
def knn_batch(spark, sf):
    return shown(V.knn(points(spark, sf), asked(spark, sf), k=10, least=None))


@query("SELECT count(*) AS points, CAST(max(len(embedding)) AS BIGINT) AS dimensions FROM embeddings")
def vector_stats(spark, sf):
    return V.vector_stats(points(spark, sf))


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS norm, len(embedding) AS n FROM embeddings")
def vector_norms(spark, sf):
    from ..functions import similarity as S

    return points(spark, sf).select("id", F.round(S.norm(F.col("vec")), 5).alias("norm"), F.size(S.l2_normalize(F.col("vec"))).cast("long").alias("n"))


#: The table's vectors are far apart: none of one label are within the deduplication threshold of 0.85.
CLOSE = 0.3
PAIRS = f"""
pairs AS (SELECT a.vec_id AS l, b.vec_id AS r, {COS.format(a='a.embedding', b='b.embedding')} AS s
          FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
          WHERE {COS.format(a='a.embedding', b='b.embedding')} >= 0.3)"""


@query(f'WITH {PAIRS} SELECT l AS "left", r AS "right", round(s, 5) AS similarity FROM pairs')
def similarity_pairs(spark, sf):
    return V.similar_pairs(points(spark, sf), CLOSE).select("left", "right", F.round("similarity", 5).alias("similarity"))


@query(f"""
WITH RECURSIVE {PAIRS},
     e AS (SELECT l AS a, r AS b FROM pairs UNION SELECT r, l FROM pairs),
     reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT a AS node, min(least(a, b)) AS component FROM reach GROUP BY a""")
def similarity_clusters(spark, sf):
    return G.connected_components(V.similar_pairs(points(spark, sf), CLOSE))


HITS = f"SELECT q.vec_id AS query_id, p.vec_id AS chunk_id, {COS.format(a='q.embedding', b='p.embedding')} AS s FROM embeddings q, embeddings p WHERE q.vec_id % 50 = 0"
TOP = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS n FROM ({HITS})) WHERE n <= 20"


def hits(spark, sf, k=20):
    return V.knn(points(spark, sf), asked(spark, sf), k=k, least=None).withColumnRenamed("id", "chunk_id")


@query(f"""
SELECT query_id, chunk_id, round(CASE WHEN mx - mn < 1e-10 THEN 1.0 ELSE (s - mn) / (mx - mn) END, 5) AS normalized
FROM (SELECT *, min(s) OVER (PARTITION BY query_id) AS mn, max(s) OVER (PARTITION BY query_id) AS mx FROM ({TOP}))""")
def score_minmax(spark, sf):
    return hits(spark, sf).withColumn("normalized", F.round(R.min_max("score"), 5)).select("query_id", "chunk_id", "normalized")


GRAPH_SCORE = "CASE WHEN chunk_id % 3 = 0 THEN (chunk_id % 10) / 10.0 END"
COVER = "(chunk_id % 4) / 4.0"
FUSED = f"""(0.4 * s + CASE WHEN chunk_id % 3 = 0 THEN 0.3 * {GRAPH_SCORE} ELSE 0 END + 0.15 * {COVER} + 0.1 * 0.5)
            / (0.4 + CASE WHEN chunk_id % 3 = 0 THEN 0.3 ELSE 0 END + 0.15 + 0.1)"""


def signals(df):
    k = F.col("chunk_id")
    return df.withColumnRenamed("score", "vector_score").withColumns(
        {"graph_score": F.when(k % 3 == 0, (k % 10) / 10.0), "entity_coverage_score": (k % 4) / 4.0, "confidence_score": F.lit(0.5)}
    )


@query(f"SELECT query_id, chunk_id, round({FUSED}, 5) AS final_score FROM ({TOP})")
def score_fusion(spark, sf):
    return R.fuse(signals(hits(spark, sf))).select("query_id", "chunk_id", F.round("final_score", 5).alias("final_score"))


@query(f"""
SELECT query_id, chunk_id, CAST(n AS INTEGER) AS rank, true AS has_more FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS n FROM ({HITS})) WHERE n > 5 AND n <= 10""")
def paged_results(spark, sf):
    return R.paged(hits(spark, sf, 50), page=2, k=5).select("query_id", "chunk_id", "rank", "has_more")


@query(f"""
SELECT query_id, chunk_id, rank, round(f, 5) AS final_score FROM
  (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f DESC, chunk_id) AS INTEGER) AS rank FROM
    (SELECT query_id, chunk_id, {FUSED} AS f FROM ({TOP}))) WHERE rank <= 10""")
def hybrid_retrieve(spark, sf):
    """Vector hits, a graph signal, fusion and the ten best of each question."""
    top = R.rank_by(R.fuse(signals(hits(spark, sf).drop("rank"))), top=10)
    return top.select("query_id", "chunk_id", "rank", F.round("final_score", 5).alias("final_score"))


@query(f"""
WITH v AS (SELECT query_id, chunk_id, s FROM ({TOP}) WHERE chunk_id % 2 = 0),
     g AS (SELECT query_id, chunk_id, (chunk_id % 10) / 10.0 AS gs, {COVER} AS cov FROM ({TOP}) WHERE chunk_id % 3 = 0)
SELECT query_id, chunk_id, round(s, 5) AS vector_score, round(gs, 5) AS graph_score, round(coalesce(cov, 0), 5) AS entity_coverage_score,
       CASE WHEN s IS NOT NULL AND gs IS NOT NULL THEN 'hybrid' WHEN s IS NOT NULL THEN 'vector' ELSE 'graph' END AS source
FROM v FULL JOIN g USING (query_id, chunk_id)""")
def hybrid_merge(spark, sf):
    h = hits(spark, sf)
    v = h.filter("chunk_id % 2 = 0").select("query_id", "chunk_id", F.col("score").alias("vector_score"), F.lit(0.0).alias("entity_coverage_score"), F.lit(0.5).alias("confidence_score"))
    g = h.filter("chunk_id % 3 = 0").select(
        "query_id", "chunk_id", (F.col("chunk_id") % 10 / 10.0).alias("graph_score"), (F.col("chunk_id") % 4 / 4.0).alias("entity_coverage_score"), F.lit(0.5).alias("confidence_score"), F.array(F.lit("p")).alias("graph_paths")
    )
    out = R.merge_hits(v, g)
    return out.select("query_id", "chunk_id", *[F.round(c, 5).alias(c) for c in ("vector_score", "graph_score", "entity_coverage_score")], "source")


@query(f"""
WITH h AS (SELECT query_id, chunk_id, s FROM ({TOP})),
     p AS (SELECT a.query_id, a.chunk_id AS path, (a.chunk_id % 5) / 5.0 AS score, b.chunk_id FROM h a JOIN h b ON a.query_id = b.query_id AND abs(a.chunk_id - b.chunk_id) <= 10)
SELECT query_id, chunk_id, round(coalesce(avg(score), 0.5), 5) AS graph_score FROM p GROUP BY ALL""")
def path_chunk_score(spark, sf):
    h = hits(spark, sf).select("query_id", "chunk_id")
    other = h.select("query_id", F.col("chunk_id").alias("path"))
    near = other.join(h, "query_id").filter(F.abs(F.col("path") - F.col("chunk_id")) <= 10)
    paths = near.groupBy("query_id", "path").agg(F.collect_list("chunk_id").alias("chunk_ids")).withColumn("score", F.col("path") % 5 / 5.0).withColumn("path", F.col("path").cast("string"))
    chunks = h.withColumn("entity_ids", F.array(F.col("chunk_id").cast("string")))
    asked_for = h.select("query_id").distinct().withColumn("entity_ids", F.array(F.lit("0")))
    return R.chunk_graph_scores(chunks, paths, asked_for).select("query_id", "chunk_id", F.round("graph_score", 5).alias("graph_score"))


def with_content(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return hits(spark, sf).join(docs, "chunk_id")


#: The hits of each question with their words' likeness to one another.
GREEDY = rf"""
WITH RECURSIVE h AS (SELECT query_id, chunk_id, {{score}} AS s, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS ws FROM ({TOP}) JOIN documents ON doc_id = chunk_id),
     o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS i FROM h),
     sim AS (SELECT a.query_id, a.chunk_id AS a, b.chunk_id AS b, CASE WHEN len(a.ws) = 0 OR len(b.ws) = 0 THEN 0.0 ELSE len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) END AS j
             FROM o a JOIN o b ON a.query_id = b.query_id AND a.chunk_id <> b.chunk_id),
     g(query_id, step, chosen, chunk_id, v, near) AS (
       SELECT query_id, 1, [chunk_id], chunk_id, CAST(s AS DOUBLE), CAST(0 AS DOUBLE) FROM o WHERE i = 1
       UNION ALL
       SELECT query_id, step + 1, list_append(chosen, best.c), best.c, best.v, best.near FROM (
         SELECT query_id, step, chosen, arg_max({{{{'c': c, 'v': v, 'near': near}}}}, row(v, -i)) AS best FROM (
           SELECT g.query_id, g.step, g.chosen, o.chunk_id AS c, o.i, max(sim.j) AS near, {{value}} AS v
           FROM g JOIN o ON o.query_id = g.query_id AND NOT list_contains(g.chosen, o.chunk_id) JOIN sim ON sim.query_id = g.query_id AND sim.a = o.chunk_id AND list_contains(g.chosen, sim.b)
           GROUP BY g.query_id, g.step, g.chosen, o.chunk_id, o.i, o.s) GROUP BY query_id, step, chosen))"""


def greedy(score: str, value: str) -> str:
    return GREEDY.replace("{score}", score).replace("{value}", value).replace("{{", "{").replace("}}", "}")


@query(greedy("s", "0.5 * o.s - (1 - 0.5) * max(sim.j)") + """
SELECT g.query_id, g.chunk_id, round(o.s, 5) AS score, CAST(step AS INTEGER) AS mmr_rank FROM g JOIN o ON o.query_id = g.query_id AND o.chunk_id = g.chunk_id""")
def mmr_rerank(spark, sf):
    return R.mmr(with_content(spark, sf)).withColumn("score", F.round("score", 5))


@query(greedy(FUSED, "o.s * (1 - 0.05) + 0.05 * (1 - max(sim.j))") + """
SELECT query_id, chunk_id, round(v, 5) AS final_score, round(1 - near, 5) AS diversity_score, rank FROM
  (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY v DESC, step) AS INTEGER) AS rank FROM g) WHERE rank <= 10""")
def diversity_rerank(spark, sf):
    fused = R.fuse(signals(with_content(spark, sf).drop("rank")))
    return R.diversify(fused).withColumns({c: F.round(c, 5) for c in ("final_score", "diversity_score")})


@query(f"""
SELECT query_id, round(greatest(0, least(1, avg(s) * 0.5)), 5) AS confidence FROM ({TOP}) GROUP BY query_id""")
def answer_confidence(spark, sf):
    from .. import constants as C

    mean = hits(spark, sf).groupBy("query_id").agg(F.avg("score").alias("m")).withColumn("answer", F.lit("a short answer"))
    return mean.select("query_id", F.round(R.answer_confidence(F.col("m"), F.col("answer"), C.REFUSALS), 5).alias("confidence"))
