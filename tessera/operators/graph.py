"""Graph operators over an edge table (id, source_entity_id, target_entity_id, type)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BOTH, OUT, IN = "both", "outgoing", "incoming"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one where that is unset on one machine (tests)."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.conf.get("tessera.graph.dir", None)
    if not own:
        own = tempfile.mkdtemp(prefix="tessera-graph-")
        spark.conf.set("tessera.graph.dir", own)
    return own


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def directed(edges: DataFrame, direction: str = OUT, types: list[str] | None = None) -> DataFrame:
    """(eid, src, dst, type) in the directions asked for; an edge keeps its id both ways."""
    if types is not None:
        edges = edges.filter(F.col("type").isin(*types))
    out = edges.select(F.col("id").alias("eid"), F.col("source_entity_id").alias("src"), F.col("target_entity_id").alias("dst"), "type")
    back = out.select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return {OUT: out, IN: back, BOTH: out.unionByName(back.filter("src <> dst"))}[direction]


def trails(edges: DataFrame, starts: DataFrame, depth: int, direction: str = OUT, types: list[str] | None = None, near: dict[int, DataFrame] | None = None) -> DataFrame:
    """start, end, depth, nodes, eids of every trail of 1..depth edges; an edge is used once, nodes may recur.

    `depth` equi-joins, one a step. Beyond two steps each is written, so no later step joins
    it again. near (step -> DataFrame of id) keeps only the ends from which a goal is near.
    """
    e = directed(edges, direction, types)
    level = starts.select(F.col("id").alias("start"), F.col("id").alias("end")).select(
        "start", "end", F.lit(0).alias("depth"), F.array("start").alias("nodes"), F.array().cast("array<string>").alias("eids")
    )
    found = None
    for d in range(1, depth + 1):
        step = level.join(e, level["end"] == e["src"]).filter(~F.array_contains("eids", F.col("eid").cast("string")))
        level = step.select(
            "start", F.col("dst").alias("end"), F.lit(d).alias("depth"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("eids", F.array(F.col("eid").cast("string"))).alias("eids")
        )
        if near:
            level = level.join(near[d].select(F.col("id").alias("end")), "end", "left_semi").select(*level.columns)
        level = written(level, "trails") if depth > 2 else level
        found = level if found is None else found.unionByName(level)
    return found


def within(edges: DataFrame, goals: DataFrame, steps: int, direction: str, types: list[str] | None = None) -> dict[int, DataFrame]:
    """For d = 0..steps the nodes from which a goal can be reached in at most d steps."""
    e = directed(edges, direction, types).select("src", "dst").distinct()
    out = {0: goals.select("id").distinct()}
    for d in range(1, steps + 1):
        before = e.join(out[d - 1], e["dst"] == out[d - 1]["id"], "left_semi").select(F.col("src").alias("id"))
        out[d] = written(out[d - 1].union(before).distinct(), "within")
    return out


def traverse(edges: DataFrame, starts: DataFrame, depth: int = 3, direction: str = OUT, types: list[str] | None = None) -> DataFrame:
    """Distinct (start, end, depth)."""
    return trails(edges, starts, depth, direction, types).select("start", "end", "depth").distinct()


def find_paths(edges: DataFrame, pairs: DataFrame, depth: int = 3, types: list[str] | None = None, limit: int = 10) -> DataFrame:
    """Up to `limit` undirected trails between each (source, target): shortest first, then by node ids.

    A trail is followed only while a target is in reach of the steps that are left.
    """
    reach = within(edges, pairs.select(F.col("target").alias("id")), depth - 1, BOTH, types)
    t = trails(edges, pairs.select(F.col("source").alias("id")).distinct(), depth, BOTH, types, {d: reach[depth - d] for d in range(1, depth + 1)})
    hit = t.join(pairs.distinct(), (t["start"] == pairs["source"]) & (t["end"] == pairs["target"]), "left_semi")
    order = W.partitionBy("start", "end").orderBy("depth", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ">"), F.array_join("eids", ">"))
    return hit.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def neighbors(edges: DataFrame, starts: DataFrame, names: DataFrame | None = None, types: list[str] | None = None) -> DataFrame:
    e = directed(edges, BOTH, types)
    out = starts.select(F.col("id").alias("start")).join(e, F.col("start") == e["src"]).select("start", F.col("dst").alias("end"), "type", "eid").distinct()
    return out if names is None else out.join(names.select(F.col("id").alias("end"), "canonical_name"), "end")


#: Directions and types of the named strategies; None takes the question's own types.
STRATEGIES = {
    "hierarchical": (("PART_OF", OUT), ("CONTAINS", OUT)),
    "sequential": (("PRECEDES", OUT), ("PRECEDES", IN)),
    "procedural": (("REFERENCES", BOTH), ("REQUIRES_CHECK", BOTH), ("PRECEDES", BOTH)),
}


def strategy_paths(edges: DataFrame, starts: DataFrame, strategy: str, depth: int = 3, types: list[str] | None = None) -> DataFrame:
    if strategy == "neighbors":
        return trails(edges, starts, 1, BOTH, types)
    if strategy == "procedural":
        return trails(edges, starts, depth, BOTH, [t for t, _ in STRATEGIES[strategy]])
    if strategy in STRATEGIES:
        parts = [trails(edges, starts, depth, way, [kind]) for kind, way in STRATEGIES[strategy]]
        if strategy == "sequential":
            parts[1] = parts[1].withColumns({"nodes": F.reverse("nodes"), "eids": F.reverse("eids")})
        return parts[0].unionByName(parts[1])
    return trails(edges, starts, depth, BOTH, types)


def existing_types(edges: DataFrame) -> DataFrame:
    """The types that edges have."""
    return edges.select("type").distinct()


def known_types(asked: list[str], edges: DataFrame) -> list[str]:
    """Those of the types asked for that edges have, in the order asked; none of them there means no result, not no filter."""
    there = {r["type"] for r in existing_types(edges.filter(F.col("type").isin(*asked))).collect()} if asked else set()
    return [t for t in asked if t in there]


def scored_paths(paths: DataFrame, top: int | None = None, by: str = "start") -> DataFrame:
    """Paths by score, the best first; of equal ones the shorter, then by nodes. rank counts within `by`."""
    order = W.partitionBy(by).orderBy(F.desc("score"), "depth", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ">"))
    out = paths.withColumn("rank", F.row_number().over(order))
    return out if top is None else out.filter(F.col("rank") <= top)


def ids_of_paths(paths: DataFrame, by: str = "start") -> DataFrame:
    """by, entity_id, kind: the distinct nodes and edges that the paths of a start go through."""
    nodes = paths.select(by, F.explode("nodes").alias("entity_id"), F.lit("node").alias("kind"))
    return nodes.union(paths.select(by, F.explode("eids"), F.lit("edge"))).distinct()


def rollup(edges: DataFrame, roots: DataFrame, leaves: DataFrame, depth: int, types: list[str] | None = None) -> DataFrame:
    """root, depth, n: the distinct nodes of `leaves` below each root, at each distance."""
    t = traverse(edges, roots, depth, OUT, types)
    return t.join(leaves.select(F.col("id").alias("end")), "end", "left_semi").groupBy(F.col("start").alias("root"), "depth").agg(F.count(F.lit(1)).alias("n"))


def path_score(length: Column, *confidences: Column) -> Column:
    mean = sum(confidences, F.lit(0.0)) / len(confidences)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 / (1 + length) + 0.4 * mean))


def connected_components(edges: DataFrame, a: str = "left", b: str = "right", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node. Alternating large-star and small-star steps.

    Nodes meet their neighbourhood's minimum in equi-joins over pre-aggregated minima, so a
    hub is never gathered; each round is written to the shared folder.
    """
    cur = written(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        cur = written(star.filter("u <> v").distinct(), "edges")
        now = tuple(cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select("v", "v").distinct())
        seen = now
    raise RuntimeError("components did not settle")


def resolve_mentions(mentions: DataFrame, entities: DataFrame, fulltext: DataFrame | None = None, vector: DataFrame | None = None) -> DataFrame:
    """mentions (query_id, mention, normalized) -> entity by exact name .95, else full text >= .8 (.9 at most), else vector >= .75.

    fulltext and vector are hit tables (query_id, mention, entity_id, score). One entity a
    mention, and an entity once a question.
    """
    exact = entities.select(F.lower(F.trim("canonical_name")).alias("normalized"), F.col("id").alias("entity_id")).groupBy("normalized").agg(F.min("entity_id").alias("entity_id"))
    hits = mentions.join(exact, "normalized").select("query_id", "mention", "entity_id", F.lit(0.95).alias("score"), F.lit(0).alias("way"))
    for way, table, least, most in ((1, fulltext, 0.8, 0.9), (2, vector, 0.75, 1.0)):
        if table is not None:
            hits = hits.unionByName(table.filter(F.col("score") >= least).select("query_id", "mention", "entity_id", F.least("score", F.lit(most)).alias("score"), F.lit(way).alias("way")))
    best = hits.groupBy("query_id", "mention").agg(F.min_by(F.struct("entity_id", "score", "way"), F.struct("way", -F.col("score"), "entity_id")).alias("r"))
    once = best.select("query_id", "mention", "r.*").withColumn("n", F.row_number().over(W.partitionBy("query_id", "entity_id").orderBy("way", F.desc("score"), "mention")))
    return once.filter("n = 1").drop("n")
