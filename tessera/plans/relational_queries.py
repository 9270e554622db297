"""Candidates, discovery, curation and change detection over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..operators import candidates as K
from ..operators import curation as U
from ..operators import discovery as D
from ..operators import graph as G
from ..operators import normalization as N
from ..operators import update as P
from ..streaming import ingest as S
from ..sources import files
from .registry import query, table, uuid5_sql


def mentions(spark, sf):
    """lineitem as mentions: part = candidate, order = chunk, supplier = document."""
    l = table(spark, sf, "lineitem")
    s = lambda c: F.col(c).cast("string")
    return l.select(
        s("l_partkey").alias("candidate_key"), F.concat(F.lit("part "), s("l_partkey")).alias("canonical_name"), F.col("l_returnflag").alias("candidate_type"),
        F.lit(1).cast("long").alias("mention_count"), F.col("l_discount").alias("confidence_score"), F.lit("pending").alias("status"),
        F.array(s("l_suppkey")).alias("source_documents"), F.array(s("l_orderkey")).alias("chunk_ids"), F.array().cast("array<string>").alias("provenance_events"),
        F.col("l_shipdate").alias("first_seen"), F.col("l_shipdate").alias("last_seen"),
    )


def folded(df):
    return df.select("candidate_key", "mention_count", F.round("confidence_score", 6).alias("confidence_score"), F.size("source_documents").cast("long").alias("documents"), F.size("chunk_ids").cast("long").alias("chunks"), "first_seen", "last_seen")


UPSERT = """SELECT CAST(l_partkey AS VARCHAR) AS candidate_key, count(*) AS mention_count, round(max(l_discount), 6) AS confidence_score,
       count(DISTINCT l_suppkey) AS documents, count(DISTINCT l_orderkey) AS chunks, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen
FROM lineitem GROUP BY l_partkey"""


@query(UPSERT)
def candidate_upsert(spark, sf):
    return folded(K.upsert_candidates(None, mentions(spark, sf)))


@query(UPSERT)
def candidate_upsert_incremental(spark, sf):
    m = mentions(spark, sf).withColumn("half", F.pmod(F.xxhash64("chunk_ids"), F.lit(2)))
    old = K.upsert_candidates(None, m.filter("half = 0").drop("half"))
    return folded(K.upsert_candidates(old, m.filter("half = 1").drop("half")))


@query("""SELECT s_nationkey AS id, CAST(max(s_suppkey) AS BIGINT) AS seq, arg_max(s_name, s_suppkey) AS name FROM supplier GROUP BY s_nationkey""")
def upsert_last_writer(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("id"), F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name"))
    return K.upsert_rows(None, s, "id", "seq").select("id", "seq", "name")


@query("SELECT l_partkey, round(least(1.0, 1 - product(1 - l_discount) + CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 0.05 ELSE 0 END), 6) AS confidence FROM lineitem GROUP BY l_partkey")
def noisy_or_confidence(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.round(K.noisy_or(F.col("l_discount"), F.col("l_linestatus")), 6).alias("confidence"))


@query("""
WITH v AS (SELECT l_partkey, l_returnflag AS t, sum(l_discount) AS v FROM lineitem GROUP BY ALL),
     b AS (SELECT l_partkey, t, v, row_number() OVER (PARTITION BY l_partkey ORDER BY round(v, 9) DESC, t DESC) AS n FROM v)
SELECT l_partkey, max(t) FILTER (n = 1) AS type, coalesce(string_agg(t, ',' ORDER BY t) FILTER (n > 1 AND round(v, 9) > 0), '') AS conflicting FROM b GROUP BY l_partkey""")
def type_vote(spark, sf):
    l = table(spark, sf, "lineitem").select("l_partkey", F.col("l_returnflag").alias("type"), F.col("l_discount").alias("confidence"))
    return K.type_vote(l, ["l_partkey"]).select("l_partkey", "type", F.array_join("conflicting_types", ",").alias("conflicting"))


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END"


def orders(spark, sf):
    s = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("candidate_key"), s.alias("status"), F.col("o_orderpriority").alias("candidate_type"), F.col("o_orderpriority").alias("type"),
        (F.col("o_totalprice") / 500000).alias("confidence_score"), F.col("o_custkey").alias("mention_count"),
    )


@query(f"SELECT count(*) AS total, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'approved') AS approved, count(*) FILTER (s = 'rejected') AS rejected FROM (SELECT {STATUS} AS s FROM orders)")
def status_counts(spark, sf):
    return K.status_counts(orders(spark, sf))


@query("SELECT p_type AS type, count(*) AS n FROM part GROUP BY p_type")
def type_counts(spark, sf):
    return K.type_counts(table(spark, sf, "part").withColumnRenamed("p_type", "type"), "type")


@query(f"SELECT count(*) AS n FROM orders WHERE {STATUS} = 'pending' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice / 500000 >= 0.5")
def filtered_total(spark, sf):
    return K.filtered_total(orders(spark, sf), "pending", ["1-URGENT", "2-HIGH"], 0.5)


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS candidate_key, round(o_totalprice / 500000, 6) AS confidence FROM orders WHERE {STATUS} = 'pending'
ORDER BY o_totalprice / 500000 DESC, o_custkey DESC, CAST(o_orderkey AS VARCHAR) OFFSET 20 LIMIT 50""")
def candidate_page(spark, sf):
    return K.page(K.scan(orders(spark, sf), "pending"), 50, 20).select("candidate_key", F.round("confidence_score", 6).alias("confidence"))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS candidate_key, CASE WHEN {STATUS} = 'pending' AND o_totalprice / 500000 < 0.5 THEN 'rejected' ELSE {STATUS} END AS status FROM orders")
def prune_weak(spark, sf):
    return K.prune_weak(orders(spark, sf)).select("candidate_key", "status")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS candidate_key, CASE WHEN o_totalprice / 500000 >= 0.9 THEN 'approve' ELSE 'skip' END AS action FROM orders WHERE {STATUS} = 'pending'")
def batch_preview(spark, sf):
    return U.by_threshold(K.scan(orders(spark, sf), "pending"), 0.9).select("candidate_key", "action")


@query("""
WITH c AS (SELECT l_partkey AS k, count(*) AS m FROM lineitem GROUP BY ALL)
SELECT (SELECT count(*) FROM c) AS candidates, CAST((SELECT sum(m) FROM c) AS BIGINT) AS mentions, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS chunks, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS documents""")
def corpus_totals(spark, sf):
    return K.corpus_statistics(K.upsert_candidates(None, mentions(spark, sf)))


@query("""
SELECT upper(p_type) AS label, count(*) AS n, array_to_string(list_sort(list_slice(list_sort(list_distinct(list(p_name))), 1, 3)), '|') AS examples
FROM part WHERE upper(p_type) <> upper((SELECT min(p_type) FROM part)) GROUP BY 1 ORDER BY n DESC, label LIMIT 10""")
def unknown_types_topk(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("canonical_name"), F.array("p_type").alias("conflicting_types"))
    known = [r[0] for r in table(spark, sf, "part").agg(F.min("p_type")).collect()]
    return K.unknown_types(p, known, top=10, examples=3).withColumn("examples", F.array_join("examples", "|"))


# ---------------------------------------------------------------- discovery


def pairs(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("key"))


PAIR_SQL = """
p AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS k FROM lineitem),
f AS (SELECT k, count(*) AS f FROM p GROUP BY k), t AS (SELECT count(DISTINCT c) AS t FROM p),
n AS (SELECT a.k AS l, b.k AS r, count(*) AS n FROM p a JOIN p b ON a.c = b.c AND a.k < b.k GROUP BY ALL),
e AS (SELECT l, r, n, round(log2(n * t / (x.f * y.f)), 6) AS pmi FROM n JOIN f x ON x.k = l JOIN f y ON y.k = r, t)"""


@query(f'WITH {PAIR_SQL} SELECT l AS "left", r AS "right", n, pmi FROM e WHERE n >= 2')
def cooccurrence_pmi(spark, sf):
    return D.cooccurrence(pairs(spark, sf), least=2, top=None)


@query(f'WITH {PAIR_SQL} SELECT l AS "left", r AS "right", n, pmi FROM e ORDER BY n DESC, l, r LIMIT 500')
def cooccurrence_top(spark, sf):
    return D.cooccurrence(pairs(spark, sf), least=1, top=500)


TOP_EDGES = f"WITH RECURSIVE {PAIR_SQL}, top AS (SELECT l, r, n FROM e ORDER BY n DESC, l, r LIMIT 500)"
REACH = """, u AS (SELECT l AS a, r AS b FROM top UNION SELECT r, l FROM top),
reach(a, b) AS (SELECT a, b FROM u UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a),
comp AS (SELECT a AS node, min(least(a, b)) AS c FROM reach GROUP BY a)"""


@query(f"{TOP_EDGES} {REACH} SELECT node, c AS component FROM comp")
def cooccurrence_components(spark, sf):
    return G.connected_components(D.cooccurrence(pairs(spark, sf), least=1, top=500))


@query(f"""{TOP_EDGES} {REACH},
s AS (SELECT c, count(*) AS size FROM comp GROUP BY c), h AS (SELECT c, round(avg(n), 6) AS cohesion FROM top JOIN comp ON node = l GROUP BY c)
SELECT c AS component, size, cohesion, CAST(row_number() OVER (ORDER BY size DESC, c) - 1 AS INTEGER) AS cluster_id FROM s JOIN h USING (c) ORDER BY size DESC, c LIMIT 50""")
def cluster_cohesion(spark, sf):
    out = D.components(D.cooccurrence(pairs(spark, sf), least=1, top=500), most=50)
    return out.select("component", "size", "cohesion", "cluster_id").distinct()


@query("SELECT c AS chunk_id, k AS key FROM (SELECT c, k, row_number() OVER (PARTITION BY c ORDER BY k) AS n FROM (SELECT DISTINCT l_orderkey AS c, l_partkey AS k FROM lineitem)) WHERE n <= 3")
def chunk_cap(spark, sf):
    return D.cap_per_chunk(pairs(spark, sf).distinct(), cap=3)


@query(f"{TOP_EDGES} SELECT node, CAST(sum(n) AS BIGINT) AS weight FROM (SELECT l AS node, n FROM top UNION ALL SELECT r, n FROM top) GROUP BY node ORDER BY weight DESC, node LIMIT 75")
def node_weights(spark, sf):
    return D.node_weights(D.cooccurrence(pairs(spark, sf), least=1, top=500))


@query()
def fuzzy_block_pairs(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("candidate_key"), F.col("p_name").alias("canonical_name"), F.concat("p_brand", "p_type").alias("candidate_type"))
    return D.fuzzy_suggestions(p, most=None)


# ---------------------------------------------------------------- curation


def approved(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("canonical_name"), F.lit("ORG").alias("entity_type"), F.array(F.concat(F.lit("alias "), F.col("s_suppkey").cast("string"))).alias("aliases"), F.lit("approved").alias("status"), F.concat(F.lit("ORG:"), F.col("s_suppkey").cast("string")).alias("candidate_key"))


@query("""SELECT lower(trim(s_name)) AS name, 'ORG' AS entity_type, CAST(s_suppkey AS VARCHAR) AS entity_id FROM supplier
UNION ALL SELECT 'alias ' || s_suppkey, 'ORG', CAST(s_suppkey AS VARCHAR) FROM supplier""")
def approved_lookup(spark, sf):
    return U.approved_lookup(approved(spark, sf))


def customers(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("  ALIAS "), k.cast("string"))).otherwise(F.col("c_name"))
    return c.select(k.cast("string").alias("candidate_key"), name.alias("canonical_name"), F.lit("ORG").alias("candidate_type"), F.array(F.concat(F.lit("Alias "), (k % 7).cast("string"))).alias("aliases"), F.array().cast("array<string>").alias("conflicting_types"), F.lit("pending").alias("status"))


RESOLVED = """
WITH a AS (SELECT 'alias ' || s_suppkey AS n, CAST(s_suppkey AS VARCHAR) AS id FROM supplier),
     c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN '  ALIAS ' || c_custkey ELSE c_name END AS name, 'Alias ' || (c_custkey % 7) AS al FROM customer)
SELECT CAST(k AS VARCHAR) AS candidate_key, coalesce(x.id, y.id) AS entity_id,
       CASE WHEN x.id IS NOT NULL THEN 'canonical_name' WHEN y.id IS NOT NULL THEN 'alias:' || al END AS reason
FROM c LEFT JOIN a x ON x.n = lower(trim(name)) LEFT JOIN a y ON y.n = lower(trim(al))"""


@query(RESOLVED)
def pre_resolution(spark, sf):
    return U.pre_resolve(customers(spark, sf), U.approved_lookup(approved(spark, sf))).select("candidate_key", "entity_id", "reason")


@query(f"SELECT candidate_key, entity_id FROM ({RESOLVED}) WHERE entity_id IS NOT NULL")
def auto_approve_existing(spark, sf):
    return U.auto_approve_existing(customers(spark, sf), U.approved_lookup(approved(spark, sf))).select("candidate_key", "entity_id")


def relation_candidates(spark, sf):
    l = table(spark, sf, "lineitem")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return l.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.when(F.col("l_returnflag") == "R", "CONTAINS").when(F.col("l_returnflag") == "A", "SUPPORTS").otherwise("ODD").alias("type"), F.col("l_discount").alias("confidence_score"), key.alias("candidate_key"), F.array(F.col("l_orderkey").cast("string")).alias("source_documents"))


def normalization_rows(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("normalized_form"), F.concat(F.lit("E-s"), F.col("s_suppkey").cast("string")).alias("canonical_id"), F.when(F.col("s_suppkey") % 2 == 0, "approved").otherwise("pending").alias("status"))
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("normalized_form"), F.concat(F.lit("E-p"), F.col("p_partkey").cast("string")).alias("canonical_id"), F.when(F.col("p_partkey") % 3 == 0, "approved").otherwise("pending").alias("status"))
    return s.unionByName(p)


@query("""
SELECT 'E-s' || l_suppkey AS source_entity_id, 'E-p' || l_partkey AS target_entity_id, CASE l_returnflag WHEN 'R' THEN 'CONTAINS' ELSE 'SUPPORTS' END AS type, round(max(l_discount), 6) AS confidence, count(DISTINCT l_orderkey) AS documents
FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_suppkey % 2 = 0 AND l_partkey % 3 = 0 GROUP BY ALL""")
def edge_promotion(spark, sf):
    e = U.promote_relations(relation_candidates(spark, sf), normalization_rows(spark, sf))
    return e.select("source_entity_id", "target_entity_id", "type", F.round("confidence_score", 6).alias("confidence"), F.size("source_documents").cast("long").alias("documents"))


@query("""
SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS candidate_key, 's' || l_suppkey AS key, 'p' || l_partkey AS peer,
       CASE WHEN l_partkey % 3 = 0 THEN 'promotable' WHEN l_partkey % 3 = 1 THEN 'resolvable' ELSE 'missing' END AS issue
FROM lineitem""")
def peer_status(spark, sf):
    r = relation_candidates(spark, sf).withColumn("status", F.lit("pending"))
    keys = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"))
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("candidate_key"), F.col("p_name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"))
    cand = p.filter("p_partkey % 3 = 1").withColumn("status", F.lit("pending"))
    ents = p.filter("p_partkey % 3 = 0").withColumn("status", F.lit("approved"))
    return U.peer_status(r, keys, cand, ents).select("candidate_key", "key", "peer", "issue")


@query("""
SELECT lower(s_name) AS normalized_form, CAST(s_suppkey AS VARCHAR) AS canonical_id, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS version,
       CASE WHEN s_suppkey % 3 = 0 THEN s_name || '|new' ELSE s_name END AS variants, CASE WHEN s_suppkey % 3 = 0 THEN 'approved' ELSE 'pending' END AS status
FROM supplier""")
def normalization_upsert(spark, sf):
    ts = F.lit("2024-01-01").cast("timestamp")
    s = table(spark, sf, "supplier")
    one = lambda v, status: [F.lower("s_name").alias("normalized_form"), v.alias("raw_variants"), F.col("s_suppkey").cast("string").alias("canonical_id"), F.col("s_name").alias("canonical_name"), F.lit("ORG").alias("entity_type"), F.lit("manual").alias("method"), F.lit(0.9).alias("confidence"), F.lit(1).alias("version"), ts.alias("created_at"), ts.alias("updated_at"), F.lit("").alias("notes"), F.lit("t").alias("source"), F.lit(status).alias("status")]
    old = N.upsert(None, s.select(*one(F.array("s_name"), "pending")))
    new = N.upsert(old, s.filter("s_suppkey % 3 = 0").select(*one(F.array(F.lit("new")), "approved")))
    return new.select("normalized_form", "canonical_id", "version", F.array_join("raw_variants", "|").alias("variants"), "status")


@query()
def duplicate_panel(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("candidate_key"), F.col("p_name").alias("canonical_name"), F.concat("p_brand", "p_type").alias("candidate_type"), F.array().cast("array<string>").alias("aliases"))
    return U.duplicates(p).withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- changes and events


def states(spark, sf):
    """An old catalog and a new scan of the documents: some modified, some gone, some moved."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    path = F.concat(F.lit("/in/"), k.cast("string"))
    sum_ = F.sha2(F.concat(k.cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))), 256)
    old = d.filter(k % 10 != 1).select(F.concat(F.lit("D"), k.cast("string")).alias("id"), path.alias("file_path"), sum_.alias("checksum"), F.lit("then").alias("last_ingested_at"))
    moved = F.when(k % 10 == 4, F.concat(F.lit("/in/moved/"), k.cast("string"))).otherwise(path)
    new = d.filter(k % 10 != 2).select(moved.alias("path"), F.when(k % 10 == 3, F.sha2(sum_, 256)).otherwise(sum_).alias("checksum"))
    return new, old


@query("""
SELECT CASE WHEN doc_id % 10 = 4 THEN '/in/moved/' || doc_id ELSE '/in/' || doc_id END AS path,
       CASE doc_id % 10 WHEN 1 THEN 'new' WHEN 2 THEN 'deleted' WHEN 3 THEN 'modified' WHEN 4 THEN 'renamed' ELSE 'unchanged' END AS status,
       CASE WHEN doc_id % 10 <> 1 THEN 'D' || doc_id END AS document_id, CASE WHEN doc_id % 10 = 4 THEN '/in/' || doc_id END AS old_path
FROM documents""")
def change_detection(spark, sf):
    return P.detect_changes(*states(spark, sf)).select("path", "status", "document_id", "old_path")


@query("SELECT CASE WHEN doc_id % 10 = 4 THEN '/in/moved/' || doc_id ELSE '/in/' || doc_id END AS file_path, 'D' || doc_id AS id FROM documents WHERE doc_id % 10 NOT IN (1, 2)")
def update_catalog(spark, sf):
    new, old = states(spark, sf)
    chunks = old.select(F.col("id").alias("document_id"))
    return P.apply_changes(old, chunks, P.detect_changes(new, old))[0].select("file_path", "id")


@query("SELECT event_type AS intent, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def history_stats(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("intent"), F.col("value").alias("intent_confidence"))
    return files.history_statistics(e).select("intent", "n", F.round("share", 4).alias("share"), F.round("mean_confidence", 4).alias("mean"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, sf):
    return S.windowed_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
     n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM n GROUP BY user_id, k""")
def audit_sessions(spark, sf):
    return S.sessions(table(spark, sf, "events"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS source, CAST(user_id AS VARCHAR) AS document_id, CASE WHEN event_id % 3 > 0 THEN 'c' || event_id END AS chunk_id,
       CASE WHEN event_id % 3 > 0 THEN value END AS confidence FROM events""")
def provenance_json(spark, sf):
    """Events as JSON provenance, every third as a bare list of documents."""
    e = table(spark, sf, "events")
    event = F.to_json(F.struct(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("document_id"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("chunk_id"), F.col("value").alias("confidence")))
    rows = e.select("event_id", F.when(F.col("event_id") % 3 > 0, F.array(event)).otherwise(F.array().cast("array<string>")).alias("provenance_events"), F.array(F.col("user_id").cast("string")).alias("source_documents"))
    return U.expand_provenance(rows).select("event_id", F.explode("provenance").alias("p")).select("event_id", "p.*")


@query("SELECT DISTINCT source AS topic FROM documents WHERE source IS NOT NULL")
def list_topics(spark, sf):
    return K.topics_of(table(spark, sf, "documents").withColumnRenamed("source", "topic"))


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src3')")
def topic_filter(spark, sf):
    return K.of_topics(table(spark, sf, "documents"), ["src1", "src3"], "source").select("doc_id")


@query(f"SELECT doc_id, {uuid5_sql("sha256(coalesce(text, ''))")} AS document_id FROM documents")
def document_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", schemas.uuid5(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("document_id"))
