"""Graph operators over regions, nations, suppliers, customers and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import candidates as K
from ..operators import graph as G
from .registry import query, table


def edges(spark, sf):
    """region -> nation -> supplier and customer as CONTAINS, customer -> order as REFERENCES."""
    t = lambda name: table(spark, sf, name)
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))

    def e(name, a, b, kind):
        return t(name).select(F.concat(a, F.lit(">"), b).alias("id"), a.alias("source_entity_id"), b.alias("target_entity_id"), F.lit(kind).alias("type"))

    parts = [
        e("nation", s("R", "n_regionkey"), s("N", "n_nationkey"), "CONTAINS"),
        e("supplier", s("N", "s_nationkey"), s("S", "s_suppkey"), "CONTAINS"),
        e("customer", s("N", "c_nationkey"), s("C", "c_custkey"), "CONTAINS"),
        e("orders", s("C", "o_custkey"), s("O", "o_orderkey"), "REFERENCES"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


EDGES = """
e AS (SELECT 'R' || n_regionkey AS s, 'N' || n_nationkey AS t, 'CONTAINS' AS type FROM nation
      UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'CONTAINS' FROM supplier
      UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'CONTAINS' FROM customer
      UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, 'REFERENCES' FROM orders),
b AS (SELECT s || '>' || t AS id, s, t, type FROM e UNION ALL SELECT s || '>' || t, t, s, type FROM e)"""


def starts(spark, *ids):
    return spark.range(1).select(F.explode(F.array(*map(F.lit, ids))).alias("id"))


@query(f"""
WITH RECURSIVE {EDGES},
     w(start, "end", depth) AS (SELECT s, t, 1 FROM e WHERE s IN ('R0', 'R1') AND type = 'CONTAINS'
                                UNION ALL SELECT start, t, depth + 1 FROM w JOIN e ON w."end" = e.s AND type = 'CONTAINS' WHERE depth < 3)
SELECT DISTINCT start, "end", depth FROM w""")
def traverse_out(spark, sf):
    return G.traverse(edges(spark, sf), starts(spark, "R0", "R1"), 3, G.OUT, ["CONTAINS"])


@query(f"""
WITH RECURSIVE {EDGES},
     w(start, "end", depth, used) AS (SELECT s, t, 1, [id] FROM b WHERE s = 'S1'
                                UNION ALL SELECT start, b.t, depth + 1, list_append(used, b.id) FROM w JOIN b ON w."end" = b.s AND NOT list_contains(used, b.id) WHERE depth < 3)
SELECT DISTINCT start, "end", depth FROM w""")
def traverse_both(spark, sf):
    return G.traverse(edges(spark, sf), starts(spark, "S1"), 3, G.BOTH)


@query(f"""
WITH RECURSIVE {EDGES},
     w(start, "end", depth, nodes, used) AS (SELECT s, t, 1, s || '>' || t, [id] FROM b WHERE s = 'S1'
                                UNION ALL SELECT start, b.t, depth + 1, nodes || '>' || b.t, list_append(used, b.id) FROM w JOIN b ON w."end" = b.s AND NOT list_contains(used, b.id) WHERE depth < 4)
SELECT start, "end", depth, nodes, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY start, "end" ORDER BY depth, nodes) AS n FROM w WHERE "end" IN ('S2', 'S3', 'R0')) WHERE n <= 10""")
def paths_limited(spark, sf):
    pairs = starts(spark, "S2", "S3", "R0").select(F.lit("S1").alias("source"), F.col("id").alias("target"))
    return G.find_paths(edges(spark, sf), pairs, 4).select("start", "end", "depth", F.array_join("nodes", ">").alias("nodes"), "rank")


@query(f"WITH {EDGES} SELECT s AS start, t AS \"end\", type FROM b WHERE s IN ('N1', 'C1')")
def neighbors(spark, sf):
    return G.neighbors(edges(spark, sf), starts(spark, "N1", "C1")).select("start", "end", "type")


@query(f"""
WITH RECURSIVE {EDGES},
     w(start, "end", depth) AS (SELECT s, t, 1 FROM e WHERE s = 'R2' UNION ALL SELECT start, t, depth + 1 FROM w JOIN e ON w."end" = e.s WHERE depth < 2)
SELECT start, "end", depth, round(0.6 / (1 + depth) + 0.4 * (0.95 + 0.95 * 0.9) / 2, 6) AS score FROM (SELECT DISTINCT start, "end", depth FROM w)""")
def path_score(spark, sf):
    t = G.traverse(edges(spark, sf), starts(spark, "R2"), 2)
    return t.withColumn("score", F.round(G.path_score(F.col("depth"), F.lit(0.95), F.lit(0.95 * 0.9)), 6))


@query(f"""
WITH {EDGES} SELECT s AS start, t AS "end", 1 AS depth FROM e WHERE s = 'C1' AND type = 'REFERENCES'
UNION ALL SELECT 'C1', e2.t, 1 FROM e e2 WHERE false""")
def strategy_procedural(spark, sf):
    return G.strategy_paths(edges(spark, sf), starts(spark, "C1"), "procedural", 1).select("start", "end", "depth")


@query(f"""
WITH RECURSIVE {EDGES}, w(start, "end", depth) AS (SELECT s, t, 1 FROM e WHERE s = 'R3' AND type = 'CONTAINS' UNION ALL SELECT start, t, depth + 1 FROM w JOIN e ON w."end" = e.s AND type = 'CONTAINS' WHERE depth < 2)
SELECT start, "end", depth FROM w""")
def strategy_hierarchical(spark, sf):
    return G.strategy_paths(edges(spark, sf), starts(spark, "R3"), "hierarchical", 2).select("start", "end", "depth")


@query("""
WITH n AS (SELECT 'REGION' AS name, count(*) AS n FROM region UNION ALL SELECT 'NATION', count(*) FROM nation),
     r AS (SELECT 'CONTAINS' AS name, (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'REFERENCES', (SELECT count(*) FROM orders))
SELECT 'entity' AS section, name, n FROM n UNION ALL SELECT 'entity', 'PLANET', 0 UNION ALL SELECT 'entity', 'total', CAST(sum(n) AS BIGINT) FROM n
UNION ALL SELECT 'relationship', name, n FROM r UNION ALL SELECT 'relationship', 'PART_OF', 0 UNION ALL SELECT 'relationship', 'total', CAST(sum(n) AS BIGINT) FROM r""")
def graph_statistics(spark, sf):
    ents = table(spark, sf, "region").select(F.lit("REGION").alias("entity_type")).unionAll(table(spark, sf, "nation").select(F.lit("NATION")))
    return K.graph_statistics(ents, edges(spark, sf), ("REGION", "NATION", "PLANET"), ("CONTAINS", "REFERENCES", "PART_OF"))


@query("SELECT r_name AS region, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def hierarchy_rollup(spark, sf):
    regions, customers = table(spark, sf, "region"), table(spark, sf, "customer")
    ids = lambda df, p, c: df.select(F.concat(F.lit(p), F.col(c).cast("string")).alias("id"))
    below = G.rollup(edges(spark, sf), ids(regions, "R", "r_regionkey"), ids(table(spark, sf, "nation"), "N", "n_nationkey").union(ids(customers, "C", "c_custkey")), 2, ["CONTAINS"])
    per = below.groupBy("root").agg(F.sum(F.when(F.col("depth") == 1, F.col("n"))).alias("nations"), F.sum(F.when(F.col("depth") == 2, F.col("n"))).alias("customers"))
    return per.join(regions, F.col("root") == F.concat(F.lit("R"), F.col("r_regionkey").cast("string"))).select(F.col("r_name").alias("region"), "nations", "customers")


@query(f"WITH {EDGES} SELECT DISTINCT type FROM e")
def relationship_types_present(spark, sf):
    return G.existing_types(edges(spark, sf))


@query("""
SELECT c_custkey AS query_id, lower(trim(s_name)) AS mention, CAST(s_suppkey AS VARCHAR) AS entity_id, CAST(0.95 AS DOUBLE) AS score
FROM customer JOIN supplier ON s_suppkey = c_custkey % 50""")
def resolve_mentions(spark, sf):
    s = table(spark, sf, "supplier")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") % 50).alias("s_suppkey"))
    m = c.join(s, "s_suppkey").select("query_id", F.lower(F.trim("s_name")).alias("mention"), F.lower(F.trim("s_name")).alias("normalized"))
    return G.resolve_mentions(m, s.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("canonical_name"))).select("query_id", "mention", "entity_id", "score")
