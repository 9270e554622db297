"""Curation, merging and discovery over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..operators import candidates as K
from ..operators import curation as U
from ..operators import discovery as D
from ..operators import graph as G
from ..operators import vectors as V
from .registry import query, table, uuid5_sql
from .storage_queries import s

# ---------------------------------------------------------------- candidates and decisions


def candidates(spark, sf):
    """Parts as pending candidates with aliases and documents."""
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    return table(spark, sf, "part").select(
        F.concat(F.lit("PART:"), s("p_partkey")).alias("candidate_key"), F.concat_ws(" ", "p_name", s("p_partkey")).alias("canonical_name"), F.col("p_brand").alias("candidate_type"), F.array(F.concat(F.lit("No "), s("p_partkey"))).alias("aliases"),
        none.alias("description"), (F.col("p_size") / 50).alias("confidence_score"), F.when(k % 7 == 0, "rejected").otherwise("pending").alias("status"), F.col("p_size").cast("long").alias("mention_count"),
        F.array((k % 50).cast("string")).alias("source_documents"), F.array(s("p_partkey")).alias("chunk_ids"), F.array().cast("array<string>").alias("conflicting_types"),
    )


def relations(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_discount").alias("c"))
    return l.select(
        F.concat_ws(":", F.concat(F.lit("p"), s("l_partkey")), F.lit("CONTAINS"), F.concat(F.lit("s"), s("l_suppkey"))).alias("candidate_key"), F.concat(F.lit("No "), s("l_partkey")).alias("source"), F.concat(F.lit("s"), s("l_suppkey")).alias("target"), F.lit("CONTAINS").alias("type"),
        F.col("c").alias("confidence_score"), F.lit("pending").alias("status"), F.array(s("l_suppkey")).alias("source_documents"),
    )


def tables(spark, sf):
    empty = lambda t: spark.createDataFrame([], schemas.struct(t))
    now = F.lit("2024-01-01").cast("timestamp")
    sup = table(spark, sf, "supplier").filter("s_suppkey % 2 = 0")
    known = sup.select(
        F.concat(F.lit("s"), s("s_suppkey")).alias("normalized_form"), F.array("s_name").alias("raw_variants"), F.concat(F.lit("E-s"), s("s_suppkey")).alias("canonical_id"), F.col("s_name").alias("canonical_name"), F.lit("ORG").alias("entity_type"), F.lit("manual").alias("method"), F.lit(1.0).alias("confidence"),
        F.lit(1).alias("version"), now.alias("created_at"), now.alias("updated_at"), F.lit("").alias("notes"), F.lit("t").alias("source"), F.lit("approved").alias("status"),
    )
    return {"entity_candidates": candidates(spark, sf), "entities": empty("entities"), "normalization": known, "relationship_candidates": relations(spark, sf), "relationships": empty("relationships")}


def decisions(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").filter("p_partkey % 3 < 2").select(F.concat(F.lit("PART:"), s("p_partkey")).alias("candidate_key"), F.when(k % 3 == 0, "approve").otherwise("reject").alias("action"), F.lit("checked").alias("reason"))


def decided(spark, sf):
    return U.decide(tables(spark, sf), decisions(spark, sf), lambda c: schemas.key_fragment(c))


@query("SELECT 'PART:' || p_partkey AS candidate_key, CASE WHEN p_partkey % 7 = 0 THEN 'rejected' WHEN p_partkey % 3 = 0 THEN 'approved' WHEN p_partkey % 3 = 1 THEN 'rejected' ELSE 'pending' END AS status FROM part")
def decide_candidates(spark, sf):
    return decided(spark, sf)["entity_candidates"].select("candidate_key", "status")


@query(f"SELECT {uuid5_sql('concat(' + repr('entity:PART:') + ', p_partkey)')} AS id, p_name || ' ' || p_partkey AS canonical_name, CAST(p_size AS BIGINT) AS mention_count FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 7 > 0")
def decide_entities(spark, sf):
    return decided(spark, sf)["entities"].select("id", "canonical_name", "mention_count")


@query("""
SELECT unnest([replace(p_name, ' ', '_') || '_' || p_partkey, 'no_' || p_partkey]) AS normalized_form, 'approved' AS status FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 7 > 0
UNION ALL SELECT 's' || s_suppkey, 'approved' FROM supplier WHERE s_suppkey % 2 = 0""")
def decide_normalization(spark, sf):
    return decided(spark, sf)["normalization"].select("normalized_form", "status")


@query("""
SELECT 'E-s' || l_suppkey AS target_entity_id, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_partkey % 3 = 0 AND l_partkey % 7 > 0 AND l_suppkey % 2 = 0 GROUP BY l_suppkey""")
def decide_edges(spark, sf):
    return decided(spark, sf)["relationships"].groupBy("target_entity_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'PART:' || p_partkey AS candidate_key, CASE WHEN p_partkey % 3 = 0 THEN 'approve' ELSE 'reject' END AS action, p_partkey % 7 > 0 AS applied FROM part WHERE p_partkey % 3 < 2""")
def decide_audit(spark, sf):
    return decided(spark, sf)["audit"].select("candidate_key", "action", "applied")


def relation_decisions(spark, sf):
    t = tables(spark, sf)
    parts = table(spark, sf, "part").filter("p_partkey % 3 = 0").select(F.concat(F.lit("no_"), s("p_partkey")).alias("normalized_form"), F.concat(F.lit("E-p"), s("p_partkey")).alias("canonical_id"), F.lit("approved").alias("status"))
    norm = t["normalization"].select("normalized_form", "canonical_id", "status").unionByName(parts)
    r = t["relationship_candidates"]
    even = F.regexp_extract("candidate_key", r"^p(\d+):", 1).cast("int") % 2 == 0
    said = r.filter(F.regexp_extract("candidate_key", r"s(\d+)$", 1).cast("int") % 5 > 0).select("candidate_key", F.when(even, "approve").otherwise("reject").alias("action"))
    return U.decide_relations(r, said, norm)


@query("""
SELECT DISTINCT 'p' || l_partkey || ':CONTAINS:s' || l_suppkey AS candidate_key,
       CASE WHEN l_suppkey % 5 = 0 THEN 'pending' WHEN l_partkey % 2 > 0 THEN 'rejected' WHEN l_partkey % 3 = 0 AND l_suppkey % 2 = 0 THEN 'approved' ELSE 'pending' END AS status,
       CASE WHEN l_suppkey % 5 = 0 OR l_partkey % 2 > 0 THEN NULL WHEN l_partkey % 3 > 0 THEN 'source not approved' WHEN l_suppkey % 2 > 0 THEN 'target not approved' END AS reason
FROM lineitem""")
def decide_relations(spark, sf):
    return relation_decisions(spark, sf)[0].select("candidate_key", "status", "reason")


@query("""
SELECT DISTINCT 'E-p' || l_partkey AS source_entity_id, 'E-s' || l_suppkey AS target_entity_id FROM lineitem
WHERE l_suppkey % 5 > 0 AND l_partkey % 6 = 0 AND l_suppkey % 2 = 0""")
def approved_relations(spark, sf):
    return relation_decisions(spark, sf)[1].select("source_entity_id", "target_entity_id")


# ---------------------------------------------------------------- undo and sessions


def log(spark, sf):
    """Events as a log of decisions: every fifth is an undo, each user is a session."""
    k = F.col("event_id")
    return table(spark, sf, "events").select(
        k.alias("seq"), s("user_id").alias("session"), F.concat(F.lit("PART:"), ((k * 7) % 2000).cast("string")).alias("candidate_key"), F.when(k % 5 == 4, "undo").when(k % 3 == 0, "approve").otherwise("reject").alias("action"), F.col("ts").alias("at")
    )


LIVE = """
e AS (SELECT event_id AS seq, user_id AS session, (event_id * 7) % 2000 AS k, CASE WHEN event_id % 5 = 4 THEN 'undo' WHEN event_id % 3 = 0 THEN 'approve' ELSE 'reject' END AS action FROM events),
d AS (SELECT *, sum(CASE action WHEN 'undo' THEN 1 ELSE -1 END) OVER (PARTITION BY session ORDER BY seq DESC) AS d FROM e),
m AS (SELECT *, least(0, coalesce(min(d) OVER (PARTITION BY session ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM d),
live AS (SELECT seq, k, action FROM m WHERE action <> 'undo' AND d < low)"""


@query(f"WITH {LIVE} SELECT seq, action FROM live")
def live_decisions(spark, sf):
    return U.live_decisions(log(spark, sf)).select("seq", "action")


@query(f"""
WITH {LIVE}, l AS (SELECT k, arg_max(action, seq) AS a FROM live GROUP BY k)
SELECT 'PART:' || p_partkey AS candidate_key, CASE a WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE CASE WHEN p_partkey % 7 = 0 THEN 'rejected' ELSE 'pending' END END AS status FROM part LEFT JOIN l ON k = p_partkey""")
def replayed_state(spark, sf):
    return U.replay(candidates(spark, sf), log(spark, sf)).select("candidate_key", "status")


@query("""
SELECT CAST(user_id AS VARCHAR) AS session, count(*) AS decisions, count(*) FILTER (event_id % 5 <> 4 AND event_id % 3 = 0) AS approved, count(*) FILTER (event_id % 5 = 4) AS undone,
       round(CASE WHEN max(ts) > min(ts) THEN count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6) ELSE 0 END, 6) AS velocity FROM events GROUP BY user_id""")
def session_statistics(spark, sf):
    return U.session_statistics(log(spark, sf)).select("session", "decisions", "approved", "undone", F.round("velocity", 6).alias("velocity"))


# ---------------------------------------------------------------- merging

#: Parts whose keys agree after division by four are one cluster.
CLUSTERS = "SELECT p_partkey // 4 AS c, arg_max('PART:' || p_partkey, row(p_size, length(p_name || ' ' || p_partkey), 'PART:' || p_partkey)) AS survivor FROM part GROUP BY 1"


def clusters(spark, sf):
    k = F.col("p_partkey")
    key = F.concat(F.lit("PART:"), k.cast("string"))
    pairs = table(spark, sf, "part").filter("p_partkey % 4 > 0").select(F.concat(F.lit("PART:"), (F.floor(k / 4) * 4).cast("string")).alias("left"), key.alias("right"))
    return U.survivors(G.connected_components(pairs), candidates(spark, sf))


@query(f"SELECT 'PART:' || p_partkey AS candidate_key, survivor FROM part JOIN ({CLUSTERS}) ON c = p_partkey // 4")
def survivors(spark, sf):
    return clusters(spark, sf)


@query(f"""
SELECT survivor AS candidate_key, CAST(sum(p_size) AS BIGINT) AS mention_count, round(max(p_size) / 50, 6) AS confidence_score, count(DISTINCT p_partkey % 50) AS documents, count(*) AS chunks,
       CAST(2 * count(*) - 1 AS BIGINT) AS aliases, arg_max(p_name || ' ' || p_partkey, 'PART:' || p_partkey = survivor) AS canonical_name
FROM part JOIN ({CLUSTERS}) ON c = p_partkey // 4 GROUP BY survivor""")
def merge_clusters(spark, sf):
    m = U.merge_clusters(candidates(spark, sf), clusters(spark, sf))
    size = lambda c: F.size(c).cast("long")
    return m.select("candidate_key", "mention_count", F.round("confidence_score", 6).alias("confidence_score"), size("source_documents").alias("documents"), size("chunk_ids").alias("chunks"), size("aliases").alias("aliases"), "canonical_name")


@query("""
SELECT p_brand AS candidate_type, CAST(sum(p_size) AS BIGINT) AS mention_count, count(*) AS merged FROM part GROUP BY p_brand""")
def auto_merge(spark, sf):
    """Merged until one candidate of each type is left: each round suggests neighbours by key."""
    from pyspark.sql import Window as W

    def suggest(c):
        w = W.partitionBy("candidate_type").orderBy("candidate_key")
        n = F.row_number().over(w)
        return c.select("candidate_type", F.col("candidate_key").alias("left"), F.lead("candidate_key").over(w).alias("right"), n.alias("n")).filter("right is not null and n % 2 = 1")

    out = U.auto_merge(candidates(spark, sf), suggest, rounds=16)
    return out.select("candidate_type", "mention_count", F.size("chunk_ids").cast("long").alias("merged"))


@query("""
SELECT l_partkey AS part, CAST(count(*) AS BIGINT) AS mention_count, round(max(l_discount), 6) AS confidence_score FROM lineitem GROUP BY l_partkey""")
def fold_survivors(spark, sf):
    l = table(spark, sf, "lineitem").select(
        s("l_partkey").alias("survivor"), F.concat_ws("-", s("l_orderkey"), s("l_linenumber")).alias("candidate_key"), F.lit("n").alias("canonical_name"), F.lit(1).cast("long").alias("mention_count"), F.col("l_discount").alias("confidence_score"), F.array().cast("array<string>").alias("aliases"),
        F.lit(None).cast("string").alias("description"), F.array(s("l_orderkey")).alias("chunk_ids"), F.array(s("l_suppkey")).alias("source_documents"),
    )
    return K.fold_survivors(l).select(F.col("survivor").cast("long").alias("part"), "mention_count", F.round("confidence_score", 6).alias("confidence_score"))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS document_id, CAST(l_partkey AS VARCHAR) AS candidate_key, count(*) AS mention_count, round(max(l_discount), 6) AS confidence_score FROM lineitem GROUP BY ALL")
def dedup_fold(spark, sf):
    l = table(spark, sf, "lineitem").select(s("l_suppkey").alias("document_id"), s("l_partkey").alias("candidate_key"), F.lit(1).cast("long").alias("mention_count"), F.col("l_discount").alias("confidence_score"), F.array(F.col("l_returnflag")).alias("aliases"), F.lit("d").alias("description"), s("l_orderkey").alias("chunk_id"))
    return K.dedup_fold(l).select("document_id", "candidate_key", "mention_count", F.round("confidence_score", 6).alias("confidence_score"))


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(1 + coalesce(m, 0) AS BIGINT) AS mention_count, CAST(coalesce(d, 0) AS BIGINT) AS documents, CAST(coalesce(n, 0) AS BIGINT) AS merged
FROM supplier LEFT JOIN (SELECT p_partkey % 150 AS e, sum(p_size) AS m, count(DISTINCT p_partkey % 50) AS d, count(*) AS n FROM part GROUP BY 1) ON e = s_suppkey""")
def merge_into_entity(spark, sf):
    none = F.array().cast("array<string>")
    ents = table(spark, sf, "supplier").select(s("s_suppkey").alias("id"), F.col("s_name").alias("canonical_name"), F.lit(1).cast("long").alias("mention_count"), F.lit(0.1).alias("confidence_score"), none.alias("aliases"), none.alias("source_documents"), none.alias("chunk_ids"), F.lit("").alias("description"), none.alias("merged_candidate_keys"))
    of = candidates(spark, sf).withColumn("entity_id", (F.regexp_extract("candidate_key", r"(\d+)$", 1).cast("int") % 150).cast("string"))
    size = lambda c: F.size(c).cast("long")
    return U.merge_into_entity(ents, of).select("id", "mention_count", size("source_documents").alias("documents"), size("merged_candidate_keys").alias("merged"))


@query("""
SELECT 'PART:' || a.p_partkey AS "left", 'PART:' || b.p_partkey AS "right", a.p_brand = b.p_brand AS same_type, CAST(a.p_size + b.p_size AS BIGINT) AS mention_count,
       CASE WHEN row(a.p_size, length(a.p_name || ' ' || a.p_partkey), 'PART:' || a.p_partkey) >= row(b.p_size, length(b.p_name || ' ' || b.p_partkey), 'PART:' || b.p_partkey) THEN 'PART:' || a.p_partkey ELSE 'PART:' || b.p_partkey END AS survivor,
       CAST(CASE WHEN a.p_partkey % 50 = b.p_partkey % 50 THEN 1 ELSE 2 END AS INTEGER) AS documents
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 25""")
def pair_comparison(spark, sf):
    k = F.col("p_partkey")
    key = lambda c: F.concat(F.lit("PART:"), c.cast("string"))
    pairs = table(spark, sf, "part").select(key(k).alias("left"), key(k + 25).alias("right"))
    return U.compare_pairs(pairs, candidates(spark, sf)).select("left", "right", "same_type", "mention_count", "survivor", "documents")


@query("SELECT lower(s_name) AS normalized_form, CAST(s_suppkey AS VARCHAR) AS canonical_id FROM supplier UNION ALL SELECT 'alias ' || s_suppkey, CAST(s_suppkey AS VARCHAR) FROM supplier")
def normalization_entries(spark, sf):
    ents = table(spark, sf, "supplier").select(s("s_suppkey").alias("id"), F.col("s_name").alias("canonical_name"), F.lit("ORG").alias("entity_type"), F.array(F.concat(F.lit("Alias "), s("s_suppkey"))).alias("aliases"))
    return U.normalization_entries(ents).select("normalized_form", "canonical_id")


# ---------------------------------------------------------------- queues


@query("SELECT 'PART:' || p_partkey AS candidate_key FROM part ORDER BY p_size DESC, p_size / 50 DESC, 'PART:' || p_partkey LIMIT 50")
def top_entities(spark, sf):
    return K.top_entities(candidates(spark, sf)).select("candidate_key")


@query("SELECT 'PART:' || p_partkey AS candidate_key FROM part WHERE p_partkey % 7 > 0 ORDER BY lower(p_name || ' ' || p_partkey), 'PART:' || p_partkey OFFSET 10 LIMIT 30")
def sorted_queue(spark, sf):
    return K.sorted_queue(K.scan(candidates(spark, sf), "pending"), "name", 30, 10).select("candidate_key")


@query("SELECT 'PART:' || p_partkey AS candidate_key FROM part WHERE p_size / 50 >= 0.5 AND p_brand = 'Brand#2' AND (contains(lower(p_name || ' ' || p_partkey), 'ring') OR contains('no ' || p_partkey, 'ring'))")
def interactive_filter(spark, sf):
    return U.filter_rows(candidates(spark, sf), 0.5, "Brand#2", "Ring").select("candidate_key")


@query("SELECT 'PART:' || p_partkey AS candidate_key FROM part WHERE p_partkey % 7 > 0 AND p_size / 50 >= 0.4 AND p_brand = 'Brand#2' AND contains(lower(p_name || ' ' || p_partkey), 'red') ORDER BY p_size DESC, p_size / 50 DESC, 'PART:' || p_partkey LIMIT 50")
def command_filter(spark, sf):
    """The review queue as the command line asks for it."""
    from ..cli import listed

    return listed(candidates(spark, sf), ["type=Brand#2", "status=pending", "confidence>=0.4", "sort=mentions", "red"]).select("candidate_key")


@query("""
SELECT type, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'R' THEN 'CONTAINS' WHEN 'A' THEN 'SUPPORTS' ELSE 'ODD' END AS type FROM lineitem) GROUP BY type""")
def top_relation_types(spark, sf):
    l = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", "CONTAINS").when(F.col("l_returnflag") == "A", "SUPPORTS").otherwise("ODD").alias("type"))
    return K.type_counts(l, "type")


# ---------------------------------------------------------------- similarity


def points(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.concat(F.lit("T"), F.col("label").cast("string")).alias("entity_type"))


COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
REACH = f"""
pairs AS (SELECT a.vec_id AS l, b.vec_id AS r, {COS} AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {COS} >= 0.3),
e AS (SELECT l AS a, r AS b FROM pairs UNION SELECT r, l FROM pairs), reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
comp AS (SELECT a AS node, min(least(a, b)) AS c FROM reach GROUP BY a)"""


@query(f"""
WITH RECURSIVE {REACH}, z AS (SELECT c, count(*) AS size FROM comp GROUP BY c), t AS (SELECT c, sum(s) AS s FROM pairs JOIN comp ON node = l GROUP BY c)
SELECT c AS component, size, round(s / (size * (size - 1) / 2), 5) AS similarity FROM z JOIN t USING (c)""")
def average_similarity(spark, sf):
    pairs = V.similar_pairs(points(spark, sf), 0.3)
    return V.average_similarity(pairs, G.connected_components(pairs)).withColumn("similarity", F.round("similarity", 5))


@query(f"""
WITH RECURSIVE {REACH}, m AS (SELECT node, c, node % 7 + 1 AS m, length(CAST(node AS VARCHAR)) AS z FROM comp),
rep AS (SELECT c, arg_min(node, row(-m, -z, node)) AS rep, count(*) AS size FROM m GROUP BY c),
links AS (SELECT l AS a, r AS b, s FROM pairs UNION ALL SELECT r, l, s FROM pairs)
SELECT rep AS source, node AS target, round(s, 5) AS similarity, round(least(1.0, 0.7 * s + 0.2 + 0.1 * least(1.0, log2(1.0 + least(rep % 7 + 1, node % 7 + 1)) / 5)), 5) AS confidence, s >= 0.95 AS auto_merge
FROM rep JOIN comp USING (c) JOIN links ON a = rep AND b = node WHERE node <> rep""")
def merge_suggestions(spark, sf):
    p = points(spark, sf).withColumns({"mention_count": F.col("id") % 7 + 1, "description": F.lit(""), "name": F.col("id").cast("string")})
    pairs = V.similar_pairs(p, 0.3)
    return V.merge_suggestions(pairs, V.clusters(pairs, p), p).withColumns({c: F.round(c, 5) for c in ("similarity", "confidence")})


@query(f"""
WITH RECURSIVE {REACH}, m AS (SELECT node, c FROM comp)
SELECT c AS component, arg_min(node, row(-(node % 7 + 1), -length(CAST(node AS VARCHAR)), node)) AS representative, count(*) AS size FROM m GROUP BY c""")
def representatives(spark, sf):
    p = points(spark, sf).withColumns({"mention_count": F.col("id") % 7 + 1, "description": F.lit(""), "name": F.col("id").cast("string")})
    return V.clusters(V.similar_pairs(p, 0.3), p).select("component", "representative", "size").distinct()


@query(f"""
SELECT query_id, id, round(s, 5) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank FROM
  (SELECT a.vec_id AS query_id, b.vec_id AS id, {COS} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.label IN (1, 4))) WHERE rank <= 3 AND s >= 0.2""")
def entity_knn(spark, sf):
    p = points(spark, sf)
    asked = p.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")
    return V.knn(V.payload_filter(p, entity_types=["T1", "T4"]), asked, k=3, least=0.2).withColumn("score", F.round("score", 5))


@query(f"""
SELECT query_id, id, round(s, 5) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank FROM
  (SELECT a.vec_id AS query_id, b.vec_id AS id, {COS} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 10""")
def knn_blocks(spark, sf):
    """The search as it runs for more questions than can be broadcast."""
    p = points(spark, sf)
    return V.knn(p, p.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vec"), k=10, least=None, broadcast_bytes=0).withColumn("score", F.round("score", 5))


@query()
def ann_search(spark, sf):
    """Approximate search through an index of cells; its recall is tested against knn."""
    p = points(spark, sf)
    centres = V.fit_cells(p, cells=16)
    asked = p.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")
    return V.ann(V.index_cells(p, centres), centres, asked, k=10, probes=13).withColumn("score", F.round("score", 5))


@query("""
SELECT CAST(a.p_partkey AS VARCHAR) AS "left", CAST(b.p_partkey AS VARCHAR) AS "right", a.p_type AS candidate_type, 'semantic' AS method, CAST(0.9 AS DOUBLE) AS confidence FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 100 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), CAST(p_partkey + 2 AS VARCHAR), p_type, 'fuzzy', CAST(0.95 AS DOUBLE) FROM part WHERE p_partkey % 200 = 0""")
def suggestion_bag(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    c = p.select(s("p_partkey").alias("candidate_key"), F.col("p_type").alias("candidate_type"))
    pairs = p.filter("p_partkey % 100 = 0").select(s("p_partkey").alias("left"), (k + 1).cast("string").alias("right"), F.lit(0.9).alias("similarity"))
    fuzzy = p.filter("p_partkey % 200 = 0").select(s("p_partkey").alias("left"), (k + 2).cast("string").alias("right"), F.col("p_type").alias("candidate_type"), F.lit(0.95).alias("score"), F.lit(0.95).alias("confidence"))
    return D.suggestions(fuzzy, D.semantic_suggestions(pairs, c), most=None).select("left", "right", "candidate_type", "method", "confidence")


# ---------------------------------------------------------------- graph


def graph(spark, sf):
    from .graph_queries import edges

    return edges(spark, sf)


@query("SELECT unnest(['CONTAINS', 'REFERENCES']) AS type")
def types_restricted(spark, sf):
    """Of the types asked for those that edges have."""
    found = G.known_types(["CONTAINS", "PART_OF", "REFERENCES", "IS_A"], graph(spark, sf))
    return spark.range(1).select(F.explode(F.array(*map(F.lit, found))).alias("type"))


@query("""
SELECT 'N' || n_nationkey AS "end", round(0.6 / 2 + 0.4 * 0.9, 6) AS score, 1 AS depth, CAST(row_number() OVER (ORDER BY 'R1>N' || n_nationkey) AS INTEGER) AS rank FROM nation WHERE n_regionkey = 1
""")
def paths_by_score(spark, sf):
    starts = spark.range(1).select(F.lit("R1").alias("id"))
    t = G.trails(graph(spark, sf), starts, 1, G.OUT, ["CONTAINS"])
    t = t.withColumn("score", G.path_score(F.col("depth"), F.lit(0.9)))
    return G.scored_paths(t, 20).select("end", F.round("score", 6).alias("score"), "depth", "rank")


@query("""
WITH n AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2), x AS (SELECT 'S' || s_suppkey AS id, s_nationkey AS k FROM supplier UNION ALL SELECT 'C' || c_custkey, c_nationkey FROM customer)
SELECT 'node' AS kind, 'R2' AS entity_id UNION ALL SELECT 'node', 'N' || k FROM n UNION ALL SELECT 'node', id FROM x JOIN n USING (k)
UNION ALL SELECT 'edge', 'R2>N' || k FROM n UNION ALL SELECT 'edge', 'N' || k || '>' || id FROM x JOIN n USING (k)""")
def path_ids(spark, sf):
    starts = spark.range(1).select(F.lit("R2").alias("id"))
    return G.ids_of_paths(G.trails(graph(spark, sf), starts, 2, G.OUT, ["CONTAINS"])).select("kind", "entity_id")


def chain(spark, sf):
    """Nations in a row: each precedes the next."""
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    return n.filter("n_nationkey < 24").select(F.concat(F.lit("e"), k.cast("string")).alias("id"), k.cast("string").alias("source_entity_id"), (k + 1).cast("string").alias("target_entity_id"), F.lit("PRECEDES").alias("type"))


@query("""
SELECT '10' AS start, CAST(10 + d AS VARCHAR) AS "end", CAST(d AS INTEGER) AS depth, array_to_string(list_transform(range(10, 11 + d), lambda x: CAST(x AS VARCHAR)), '>') AS nodes FROM range(1, 4) t(d)
UNION ALL SELECT '10', CAST(10 - d AS VARCHAR), CAST(d AS INTEGER), array_to_string(list_transform(range(10 - d, 11), lambda x: CAST(x AS VARCHAR)), '>') FROM range(1, 4) t(d)""")
def strategy_sequential(spark, sf):
    t = G.strategy_paths(chain(spark, sf), spark.range(1).select(F.lit("10").alias("id")), "sequential", 3)
    return t.select("start", "end", "depth", F.array_join("nodes", ">").alias("nodes"))


@query("""
WITH m AS (SELECT c_custkey AS q, c_custkey % 120 AS k FROM customer)
SELECT q AS query_id, CASE WHEN k < (SELECT count(*) FROM supplier) THEN CAST(k AS VARCHAR) WHEN k % 2 = 0 THEN 'F' || k ELSE 'V' || k END AS entity_id,
       CASE WHEN k < (SELECT count(*) FROM supplier) THEN CAST(0.95 AS DOUBLE) WHEN k % 2 = 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS score
FROM m WHERE k < (SELECT count(*) FROM supplier) OR k % 2 = 0 OR k % 3 = 0""")
def resolution_cascade(spark, sf):
    """By exact name, else full text of at least .8 (counted as .9 at most), else vector of at least .75."""
    k = F.col("c_custkey") % 120
    m = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("m"), k.cast("string")).alias("mention"), F.format_string("supplier#%09d", k).alias("normalized"), k.alias("k"))
    ents = table(spark, sf, "supplier").select(s("s_suppkey").alias("id"), F.col("s_name").alias("canonical_name"))
    hit = lambda p, score: m.select("query_id", "mention", F.concat(F.lit(p), F.col("k").cast("string")).alias("entity_id"), score.alias("score"))
    text = hit("F", F.when(F.col("k") % 2 == 0, 3.5).otherwise(0.7))
    near = hit("V", F.when(F.col("k") % 3 == 0, 0.8).otherwise(0.7))
    return G.resolve_mentions(m.drop("k"), ents, text, near).select("query_id", "entity_id", F.col("score").cast("double").alias("score"))
