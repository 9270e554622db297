"""Scans, lookups, upserts, deletes and the normalisation table, over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..operators import candidates as K
from ..operators import normalization as N
from ..operators import update as P
from ..operators import vectors as V
from ..sources import files
from ..sources import store as T
from .registry import query, table, uuid5_sql

s = lambda c: F.col(c).cast("string")


def entities(spark, sf):
    """Parts as entities: named, typed by brand, pending or approved by size."""
    return table(spark, sf, "part").select(
        s("p_partkey").alias("id"), F.concat_ws(" ", "p_name", s("p_partkey")).alias("canonical_name"), F.col("p_brand").alias("entity_type"), F.when(F.col("p_size") % 2 == 0, "approved").otherwise("pending").alias("status"),
        F.array(F.lower("p_type")).alias("aliases"), F.col("p_type").alias("description"), F.col("p_retailprice").alias("confidence_score"),
    )


def chunks(spark, sf):
    """Line items as chunks: order = document, line number = level and path."""
    l = table(spark, sf, "lineitem")
    k = F.col("l_linenumber")
    return l.select(
        F.concat_ws("-", s("l_orderkey"), s("l_linenumber"), s("l_partkey"), s("l_suppkey")).alias("chunk_id"), s("l_orderkey").alias("document_id"), (k % 4 + 1).cast("int").alias("level"), F.concat_ws(".", s("l_linenumber"), s("l_suppkey")).alias("hierarchy_path"),
        F.array(F.concat(F.lit("p"), s("l_partkey")), F.concat(F.lit("s"), s("l_suppkey"))).alias("entity_ids"),
    )


CHUNKS = """
c AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS chunk_id, CAST(l_orderkey AS VARCHAR) AS document_id, CAST(l_linenumber % 4 + 1 AS INTEGER) AS level,
             concat_ws('.', l_linenumber, l_suppkey) AS hierarchy_path, l_partkey AS p, l_suppkey AS s FROM lineitem)"""


# ---------------------------------------------------------------- scans and lookups


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' ' || p_partkey AS canonical_name FROM part WHERE p_brand = 'Brand#2' AND p_size % 2 = 0
ORDER BY p_name || ' ' || p_partkey, CAST(p_partkey AS VARCHAR) OFFSET 5 LIMIT 20""")
def entity_listing(spark, sf):
    return K.list_entities(entities(spark, sf), "Brand#2", "approved", 20, 5).select("id", "canonical_name")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE lower(p_name || ' ' || p_partkey) = 'small ring 0'")
def entity_by_name(spark, sf):
    return T.by_name(entities(spark, sf), "  Small RING 0 ").select("id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS entity_type FROM part WHERE p_partkey = 17")
def entity_by_key(spark, sf):
    return T.by_key(entities(spark, sf), "17").select("id", "entity_type")


@query(f"WITH {CHUNKS} SELECT chunk_id, level, hierarchy_path FROM c WHERE document_id = '7' AND level = 2")
def chunks_of_document(spark, sf):
    return T.chunks_of_document(chunks(spark, sf).distinct(), "7", 2).select("chunk_id", "level", "hierarchy_path")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_size = 10 ORDER BY id LIMIT 100")
def rows_by_ids(spark, sf):
    ids = table(spark, sf, "part").filter("p_size = 10").select(s("p_partkey").alias("id"))
    return T.by_ids(entities(spark, sf), ids, limit=100).select("id")


@query(f"WITH {CHUNKS} SELECT chunk_id FROM c WHERE p IN (1, 2, 3) OR s = 7 ORDER BY level, hierarchy_path, chunk_id LIMIT 100")
def chunks_for_entities(spark, sf):
    return T.chunks_for_entities(chunks(spark, sf), ["p1", "p2", "p3", "s7"]).select("chunk_id")


@query("SELECT n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey = 2")
def sql_pass_through(spark, sf):
    table(spark, sf, "nation").createOrReplaceTempView("pass_through_nation")
    return T.sql(spark, "SELECT n_name AS name, n_regionkey AS region FROM pass_through_nation WHERE n_regionkey = :r", r=2)


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date,
       CASE WHEN o_orderkey % 4 < 3 THEN '1.' || o_orderkey % 10 END AS version FROM orders""")
def dates_and_versions(spark, sf):
    """What first pages say: ISO and American dates, a bare date, and one that is none."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    iso, us = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "MM/dd/yyyy")
    ver = F.concat(F.lit(" Version 1."), (k % 10).cast("string"))
    text = F.when(k % 4 == 0, F.concat(F.lit("Date: "), iso, ver)).when(k % 4 == 1, F.concat(F.lit("DATE "), us, ver)).when(k % 4 == 2, F.concat(F.lit("seen "), iso, ver)).otherwise(F.lit("date: 2024-13-45"))
    return o.select("o_orderkey", files.date_of(text).alias("date"), files.version_of(text).alias("version"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CASE WHEN o_orderkey % 3 > 0 THEN 'T' || o_orderkey END AS title, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders")
def pdf_metadata(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    said = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("120000Z"))
    info = F.create_map(F.lit("Title"), F.when(k % 3 > 0, F.concat(F.lit(" T"), k.cast("string"))).otherwise(F.lit(" ")), F.when(k % 2 == 0, "CreationDate").otherwise("ModDate"), F.when(k % 5 > 0, said).otherwise(F.lit("")))
    rows = o.select(k.cast("string").alias("document_id"), info.alias("info"), F.lit(3).alias("page_count"), F.lit("").alias("first_page"))
    return files.pdf_metadata(rows).select("document_id", "title", "date")


def items(spark, sf):
    """Line items as the labelled items of a PDF: order = document."""
    l = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    label = F.when(n == 1, "section_header").when(n % 3 == 0, "subsection_header").when(n % 5 == 0, "table").otherwise("text")
    return l.groupBy("l_orderkey", n).agg(F.min("l_partkey").alias("p")).select(s("l_orderkey").alias("document_id"), n.alias("pos"), label.alias("label"), F.concat(F.lit("t"), s("p")).alias("text"))


ITEMS = """
i AS (SELECT CAST(l_orderkey AS VARCHAR) AS d, l_linenumber AS pos, 't' || min(l_partkey) AS t, CASE WHEN l_linenumber = 1 THEN 'h' WHEN l_linenumber % 3 = 0 THEN 'u' WHEN l_linenumber % 5 = 0 THEN 'table' ELSE 'text' END AS label FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


@query(f"""
WITH {ITEMS}, n AS (SELECT *, sum(CAST(label = 'h' AS INTEGER)) OVER w AS s FROM i WINDOW w AS (PARTITION BY d ORDER BY pos)),
     m AS (SELECT *, sum(CAST(label = 'u' AS INTEGER)) OVER (PARTITION BY d, s ORDER BY pos) AS u FROM n WHERE s > 0)
SELECT d AS document_id, CAST(s AS BIGINT) AS s, CAST(u AS BIGINT) AS u, arg_min(t, pos) AS title, coalesce(string_agg(t, chr(10) ORDER BY pos) FILTER (label NOT IN ('h', 'u')), '') AS content FROM m GROUP BY d, s, u""")
def pdf_sections(spark, sf):
    return files.pdf_sections(items(spark, sf))


@query(f"WITH {ITEMS} SELECT d AS document_id, t AS text, CAST(row_number() OVER (PARTITION BY d ORDER BY pos) AS INTEGER) AS position FROM i WHERE label = 'table'")
def pdf_tables(spark, sf):
    return files.pdf_elements(items(spark, sf), files.TABLES).select("document_id", "text", "position")


@query("""
WITH d AS (SELECT o_custkey AS batch, o_orderkey AS k, o_orderstatus = 'F' AS bad FROM orders),
     i AS (SELECT *, sum(CAST(NOT bad AS INTEGER)) OVER (PARTITION BY batch ORDER BY k) AS i FROM d),
     r AS (SELECT *, sum(CAST(bad AS INTEGER)) OVER (PARTITION BY batch, i ORDER BY k) AS r FROM i),
     c AS (SELECT batch, min(k) AS stop FROM r WHERE r >= 2 GROUP BY batch)
SELECT d.batch, d.k FROM d LEFT JOIN c USING (batch) WHERE stop IS NULL OR k <= stop""")
def error_streaks(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "failed").alias("error"))
    return files.error_streak(o, "k", most=2).select("batch", "k")


# ---------------------------------------------------------------- writes


@query("""
SELECT 's' || l_suppkey || ':CONTAINS:p' || l_partkey AS candidate_key, count(*) AS mention_count, round(max(l_discount), 6) AS confidence_score, count(DISTINCT l_orderkey) AS documents FROM lineitem GROUP BY ALL""")
def relation_upsert(spark, sf):
    l = table(spark, sf, "lineitem")
    rows = l.select(
        schemas.relationship_key(F.concat(F.lit("s"), s("l_suppkey")), F.lit("CONTAINS"), F.concat(F.lit("p"), s("l_partkey"))).alias("candidate_key"), F.lit(1).cast("long").alias("mention_count"), F.col("l_discount").alias("confidence_score"),
        F.array(s("l_orderkey")).alias("source_documents"), F.col("l_shipdate").alias("first_seen"), F.col("l_shipdate").alias("last_seen"),
    )
    return K.upsert_candidates(None, rows).select("candidate_key", "mention_count", F.round("confidence_score", 6).alias("confidence_score"), F.size("source_documents").cast("long").alias("documents"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer UNION ALL SELECT 'S' || s_suppkey FROM supplier")
def strict_create(spark, sf):
    c = table(spark, sf, "customer").select(s("c_custkey").alias("id"))
    return K.append_strict(c, table(spark, sf, "supplier").select(F.concat(F.lit("S"), s("s_suppkey")).alias("id")), "id")


def edges(spark, sf):
    return table(spark, sf, "orders").select(s("o_orderkey").alias("id"), F.lit("REFERENCES").alias("type"), F.concat(F.lit("C"), s("o_custkey")).alias("source_entity_id"), F.concat(F.lit("N"), (F.col("o_custkey") % 40).cast("string")).alias("target_entity_id"))


def known_ends(spark, sf):
    c = table(spark, sf, "customer").filter("c_custkey % 3 > 0").select(F.concat(F.lit("C"), s("c_custkey")).alias("id"))
    return c.union(table(spark, sf, "nation").select(F.concat(F.lit("N"), s("n_nationkey"))))


ENDS = "o_custkey % 3 > 0 AND o_custkey IN (SELECT c_custkey FROM customer) AND o_custkey % 40 IN (SELECT n_nationkey FROM nation)"


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, 'C' || o_custkey AS source_entity_id FROM orders WHERE {ENDS}")
def edge_upsert(spark, sf):
    return K.upsert_edges(None, edges(spark, sf), known_ends(spark, sf))[0].select("id", "source_entity_id")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE NOT ({ENDS})")
def edge_rejects(spark, sf):
    return K.upsert_edges(None, edges(spark, sf), known_ends(spark, sf))[1].select("id")


def placed(spark, sf):
    """Orders with their lines as children: some documents and some parents aren't there."""
    o = table(spark, sf, "orders").select(F.concat(F.lit("o"), s("o_orderkey")).alias("chunk_id"), s("o_custkey").alias("document_id"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("gone")).alias("parent_chunk_id"))
    d = table(spark, sf, "customer").filter("c_custkey % 5 > 0").select(s("c_custkey").alias("document_id"))
    return o, d


PLACED = "o_custkey % 5 > 0 AND o_custkey IN (SELECT c_custkey FROM customer) AND o_orderkey % 7 > 0"


@query(f"SELECT 'o' || o_orderkey AS chunk_id, CAST(o_custkey AS VARCHAR) AS document_id FROM orders WHERE {PLACED}")
def chunk_upsert(spark, sf):
    return K.upsert_chunks(None, *placed(spark, sf))[0].select("chunk_id", "document_id")


@query(f"SELECT 'o' || o_orderkey AS chunk_id FROM orders WHERE NOT ({PLACED})")
def chunk_rejects(spark, sf):
    return K.upsert_chunks(None, *placed(spark, sf))[1].select("chunk_id")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 3 = 0 THEN 'new ' || p_partkey ELSE p_name || ' ' || p_partkey END AS canonical_name, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS description,
       p_brand AS entity_type FROM part""")
def partial_update(spark, sf):
    k = F.col("p_partkey")
    changes = table(spark, sf, "part").filter("p_partkey % 3 = 0 or p_partkey % 5 = 0").select(
        s("p_partkey").alias("id"), F.when(k % 3 == 0, F.concat(F.lit("new "), s("p_partkey"))).alias("canonical_name"), F.lit("X").alias("entity_type"), F.when(k % 5 == 0, F.array(F.lit("description"))).alias("cleared")
    )
    return K.patch(entities(spark, sf), changes, "id", ("canonical_name", "description")).select("id", "canonical_name", "description", "entity_type")


@query("SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS entity_id, CAST(l_orderkey AS VARCHAR) AS document_id FROM lineitem")
def entity_document_links(spark, sf):
    l = table(spark, sf, "lineitem").select(s("l_partkey").alias("entity_id"), F.array(s("l_orderkey"), s("l_orderkey")).alias("documents"))
    old = table(spark, sf, "lineitem").filter("l_partkey % 2 = 0").select(s("l_partkey").alias("entity_id"), s("l_orderkey").alias("document_id"))
    return K.links(old, l, "entity_id", "documents", "document_id")


@query("SELECT doc_id, unnest(['t1', source]) AS topic FROM documents")
def document_topic_links(spark, sf):
    return K.links(None, table(spark, sf, "documents").select("doc_id", F.array(F.lit("t1"), "source").alias("topics")), "doc_id", "topics", "topic")


@query("SELECT 'entity' AS kind, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_custkey % 4 > 0 UNION ALL SELECT 'edge', count(*) FROM orders WHERE o_custkey % 4 > 0")
def detach_delete(spark, sf):
    ents = table(spark, sf, "customer").select(F.concat(F.lit("C"), s("c_custkey")).alias("id"))
    gone = table(spark, sf, "customer").filter("c_custkey % 4 = 0").select(F.concat(F.lit("C"), s("c_custkey")).alias("id"))
    left, rest = K.detach_delete(ents, edges(spark, sf), gone)
    return left.agg(F.count(F.lit(1)).alias("n")).select(F.lit("entity").alias("kind"), "n").union(rest.agg(F.count(F.lit(1))).select(F.lit("edge"), F.col("count(1)")))


@query("SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS chunk_id, CASE WHEN l_orderkey = 7 THEN 'inactive' ELSE 'active' END AS status FROM lineitem")
def soft_delete(spark, sf):
    return K.deactivate_document(chunks(spark, sf).withColumn("status", F.lit("active")), "7").select("chunk_id", "status")


@query("SELECT vec_id AS id, round(CASE WHEN vec_id % 2 = 0 THEN 2 * embedding[1] ELSE embedding[1] END, 5) AS first FROM embeddings WHERE vec_id % 10 > 0")
def vector_upsert(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    new = e.filter("id % 2 = 0").withColumn("vec", F.transform("vec", lambda x: 2 * x))
    out = K.delete_keys(K.upsert_vectors(e, new, 64), e.filter("id % 10 = 0"), "id")
    return out.select("id", F.round(F.get("vec", F.lit(0)), 5).alias("first"))


@query("SELECT vec_id FROM embeddings WHERE label <> 3")
def vectors_of_document_deleted(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("document_id"))
    return K.delete_keys(e, e.filter("document_id = 3"), "document_id").select("vec_id")


@query("SELECT 'D' || doc_id AS id FROM documents WHERE doc_id % 10 = 3")
def outdated_documents(spark, sf):
    """Files whose path is now another document."""
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("/in/"), s("doc_id"))
    old = d.select(F.concat(F.lit("D"), s("doc_id")).alias("id"), path.alias("file_path"))
    new = d.select(F.concat(F.lit("D"), s("doc_id"), F.when(F.col("doc_id") % 10 == 3, "new").otherwise("")).alias("document_id"), path.alias("file_path"))
    return P.outdated(new, old)


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 3 <> 0")
def to_ingest(spark, sf):
    """New and changed documents; a completed one with the same checksum is skipped."""
    d = table(spark, sf, "documents")
    sum_ = F.sha2(F.coalesce("text", F.lit("")), 256)
    k = F.col("doc_id")
    done = d.filter(k % 3 == 0).select(s("doc_id").alias("id"), F.when(k % 4 == 0, "old").otherwise(sum_).alias("checksum"), F.lit("completed").alias("ingestion_status"))
    return P.to_ingest(d.select(s("doc_id").alias("document_id"), sum_.alias("checksum"), "doc_id"), done).select("doc_id")


# ---------------------------------------------------------------- filters


@query("""
WITH c AS (SELECT 's' || l_suppkey || ':CONTAINS:p' || l_partkey AS k, min(l_returnflag) AS f FROM lineitem GROUP BY ALL)
SELECT k AS candidate_key FROM c WHERE f <> 'R' AND (starts_with(k, 's7:') OR ends_with(k, ':p11') OR starts_with(k, 's3:CONTAINS:') OR ends_with(k, ':CONTAINS:p5')) ORDER BY k LIMIT 200""")
def key_match(spark, sf):
    """Relation candidates that involve any of some keys, two of which hold a colon themselves."""
    l = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("s"), s("l_suppkey"), F.lit(":CONTAINS:p"), s("l_partkey")).alias("candidate_key")).agg(F.min("l_returnflag").alias("status"))
    keys = spark.range(1).select(F.explode(F.array(*map(F.lit, ("s7", "p11", "s3:CONTAINS", "CONTAINS:p5", "nothing")))).alias("key"))
    return K.involving_keys(l, keys, ["A", "N"]).select("candidate_key")


_ENTITY_TEXT = "p_name || ' ' || p_partkey || ' ' || lower(p_type) || ' ' || p_type"
_TOKENS = r"regexp_extract_all(lower(x), '[\p{L}\p{N}]+')"


def _search_sql(keep: str) -> str:
    return f"""
WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS id, {_ENTITY_TEXT} AS x, p_brand, p_size FROM part),
     tf AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest({_TOKENS}) AS token FROM d) GROUP BY ALL), ln AS (SELECT id, len({_TOKENS}) AS l FROM d),
     st AS (SELECT count(*) AS n, avg(l) AS a FROM ln), q AS (SELECT DISTINCT query_id, unnest({_TOKENS}) AS token FROM (SELECT n_nationkey AS query_id, CASE n_nationkey % 3 WHEN 0 THEN 'red ring' WHEN 1 THEN 'small widget standard' ELSE 'economy 17' END AS x FROM nation)),
     df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
     sc AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / a))) AS s FROM q JOIN tf USING (token) JOIN df USING (token) JOIN ln USING (id), st GROUP BY ALL)
SELECT query_id, id, round(s, 4) AS score, rank FROM (SELECT query_id, id, s, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS INTEGER) AS rank FROM sc JOIN d USING (id) WHERE {keep}) WHERE rank <= 10"""


def questions(spark, sf):
    k = F.col("n_nationkey") % 3
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), F.when(k == 0, "red ring").when(k == 1, "small widget standard").otherwise("economy 17").alias("text"))


@query(_search_sql("p_brand IN ('Brand#2', 'Brand#17', 'Brand#5') AND p_size % 2 = 0"))
def entity_search(spark, sf):
    from ..operators import search as B

    found = B.search_entities(entities(spark, sf), questions(spark, sf), types=["Brand#2", "Brand#17", "Brand#5"], status="approved")
    return found.withColumn("score", F.round("score", 4))


@query(_search_sql("true"))
def candidate_search(spark, sf):
    from ..operators import search as B

    rows = entities(spark, sf).withColumnsRenamed({"id": "candidate_key", "entity_type": "candidate_type"})
    return B.search_entities(rows, questions(spark, sf), kind="candidate_type", id_col="candidate_key").withColumn("score", F.round("score", 4))


@query("SELECT CAST(p_partkey AS VARCHAR) AS candidate_key FROM part WHERE contains(lower(p_name || ' ' || p_partkey), 'ring 1') OR contains(CAST(p_partkey AS VARCHAR), 'ring 1') ORDER BY lower(p_name || ' ' || p_partkey), candidate_key LIMIT 10")
def palette_search(spark, sf):
    from ..operators import search as B

    return B.palette(entities(spark, sf).withColumnRenamed("id", "candidate_key"), "Ring 1").select("candidate_key")


# ---------------------------------------------------------------- normalisation table


def normalization(spark, sf):
    k = F.col("s_suppkey")
    ts = F.timestamp_seconds(1700000000 + k % 9)
    return table(spark, sf, "supplier").select(
        F.lower("s_name").alias("normalized_form"), F.array("s_name", F.concat(F.lit("alias "), s("s_suppkey"))).alias("raw_variants"), s("s_suppkey").alias("canonical_id"), F.col("s_name").alias("canonical_name"), F.when(k % 2 == 0, "ORG").otherwise("UNIT").alias("entity_type"),
        F.when(k % 5 == 0, "fuzzy").otherwise("manual").alias("method"), ((k % 10) / 10.0).alias("confidence"), F.lit(1).alias("version"), ts.alias("created_at"), ts.alias("updated_at"), F.lit("").alias("notes"), F.lit("t").alias("source"), F.when(k % 3 == 0, "approved").otherwise("pending").alias("status"),
    )


@query("SELECT lower(s_name) AS normalized_form FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 10 >= 4 ORDER BY s_suppkey % 10 DESC, s_suppkey % 9, lower(s_name) LIMIT 15")
def normalization_queue(spark, sf):
    return N.queue(normalization(spark, sf), 0.4, "ORG", "pending", limit=15).select("normalized_form")


@query("SELECT lower(s_name) AS normalized_form FROM supplier WHERE contains(lower(s_name), '000000001') OR contains('alias ' || s_suppkey, '000000001')")
def normalization_search(spark, sf):
    return N.search(normalization(spark, sf), "000000001").select("normalized_form")


@query("""
SELECT 'status' AS section, CASE WHEN s_suppkey % 3 = 0 THEN 'approved' ELSE 'pending' END AS name, count(*) AS n FROM supplier GROUP BY ALL
UNION ALL SELECT 'method', CASE WHEN s_suppkey % 5 = 0 THEN 'fuzzy' ELSE 'manual' END, count(*) FROM supplier GROUP BY ALL
UNION ALL SELECT 'entity_type', CASE WHEN s_suppkey % 2 = 0 THEN 'ORG' ELSE 'UNIT' END, count(*) FROM supplier GROUP BY ALL""")
def normalization_statistics(spark, sf):
    return N.statistics(normalization(spark, sf))


@query("SELECT c_custkey, CASE WHEN c_custkey % 200 < (SELECT count(*) FROM supplier) THEN CAST(c_custkey % 200 AS VARCHAR) END AS canonical_id FROM customer")
def normalization_lookup(spark, sf):
    names = table(spark, sf, "customer").select("c_custkey", F.format_string("SUPPLIER#%09d", F.col("c_custkey") % 200).alias("name"))
    return N.lookup(names, normalization(spark, sf), F.lower("name")).select("c_custkey", "canonical_id")


@query("SELECT lower(s_name) AS normalized_form, s_name || ' | alias ' || s_suppkey AS raw_variants, printf('%.3f', (s_suppkey % 10) / 10.0) AS confidence FROM supplier")
def normalization_csv(spark, sf):
    return N.to_csv_rows(normalization(spark, sf)).select("normalized_form", "raw_variants", "confidence")


@query("SELECT lower(s_name) AS normalized_form, list_sort(['alias ' || s_suppkey, s_name]) AS variants FROM supplier")
def normalization_variants(spark, sf):
    return normalization(spark, sf).select("normalized_form", N.variants(F.concat(F.lit(" "), F.array_join("raw_variants", " | "), F.lit("|| "), F.get("raw_variants", F.lit(0)))).alias("variants"))


@query("SELECT lower(s_name) AS normalized_form FROM supplier WHERE s_suppkey % 4 > 0")
def normalization_remove(spark, sf):
    t = normalization(spark, sf)
    return N.remove(t, t.filter("cast(canonical_id as int) % 4 = 0")).select("normalized_form")


# ---------------------------------------------------------------- identifiers


@query(f"SELECT p_partkey, 'COMPONENT:' || replace(p_name, ' ', '_') AS candidate_key, {uuid5_sql(chr(39) + 'entity_candidate:COMPONENT:' + chr(39) + ' || replace(p_name, ' + repr(' ') + ', ' + repr('_') + ')')} AS id FROM part")
def candidate_ids(spark, sf):
    key = schemas.candidate_key(F.lit("COMPONENT"), F.col("p_name"), s("p_partkey"))
    return table(spark, sf, "part").select("p_partkey", key.alias("candidate_key"), schemas.candidate_id(key).alias("id"))


@query("SELECT count(*) AS texts, count(*) FILTER (doc_id IN (SELECT min(doc_id) FROM documents WHERE doc_id % 2 = 0 GROUP BY md5(text)) OR md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)) AS hits FROM documents")
def cache_hits(spark, sf):
    """Texts whose vector a cache of every second document has."""
    d = table(spark, sf, "documents")
    cache = d.filter("doc_id % 2 = 0").select(F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
    return V.cache_hits(d, F.col("text"), cache, max_tokens=1 << 24).select("texts", "hits")
