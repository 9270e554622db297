"""Corpus discovery: co-occurrence, clusters, merge suggestions, report files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as S
from . import graph


def cap_per_chunk(pairs: DataFrame, cap: int = 50, chunk: str = "chunk_id", key: str = "key", order=None) -> DataFrame:
    """At most `cap` candidates a chunk, a feature of the report: the first by `order` (by default the key)."""
    n = F.row_number().over(W.partitionBy(chunk).orderBy(*(order or [F.col(key)]), key))
    return pairs.select(chunk, key, *([] if order is None else [c for c in pairs.columns if c not in (chunk, key)])).withColumn("_n", n).filter(F.col("_n") <= cap).select(chunk, key)


def cooccurrence(pairs: DataFrame, cap: int = 50, least: int = 2, top: int | None = 500, chunk: str = "chunk_id", key: str = "key") -> DataFrame:
    """left < right, n (chunks with both, after the cap), pmi (from uncapped frequencies)."""
    full = pairs.select(chunk, key).distinct()
    used = cap_per_chunk(full, cap, chunk, key)
    a, b = used.select(chunk, F.col(key).alias("left")), used.select(chunk, F.col(key).alias("right"))
    n = a.join(b, chunk).filter("left < right").groupBy("left", "right").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    freq = full.groupBy(key).agg(F.count(F.lit(1)).alias("f"))
    total = full.agg(F.count_distinct(chunk).alias("chunks"))
    out = n.join(freq.select(F.col(key).alias("left"), F.col("f").alias("fl")), "left").join(freq.select(F.col(key).alias("right"), F.col("f").alias("fr")), "right")
    out = out.crossJoin(F.broadcast(total))
    pmi = F.log2(F.col("n") * F.col("chunks") / (F.col("fl") * F.col("fr")))
    out = out.select("left", "right", "n", F.round(pmi, 6).alias("pmi"))
    return out if top is None else out.orderBy(F.desc("n"), "left", "right").limit(top)


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """Clusters of the co-occurrence graph: cluster_id by size, size, cohesion (mean count inside), members."""
    comp = graph.connected_components(edges)
    inside = edges.join(comp, edges["left"] == comp["node"]).groupBy("component").agg(F.round(F.avg("n"), 6).alias("cohesion"))
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    ranked = sizes.join(inside, "component").orderBy(F.desc("size"), "component").limit(most)
    order = F.row_number().over(W.orderBy(F.desc("size"), "component")) - 1  # of `most` rows
    return ranked.withColumn("cluster_id", order).join(comp.withColumnRenamed("node", "member"), "component")


def fuzzy_suggestions(candidates: DataFrame, threshold: float = 0.9, prefix: int = 4, most: int | None = 100) -> DataFrame:
    """Pairs of one type whose names start alike and score over the adaptive threshold.

    Distinct names are compared, each two once, and only pairs that pass meet the candidates
    that have them; a frequent type and beginning is a skewed key, which the join splits.
    """
    c = candidates.select("candidate_key", "candidate_type", F.lower(F.trim("canonical_name")).alias("name")).withColumn("block", F.substring("name", 1, prefix))
    names = c.select("candidate_type", "block", "name").distinct()
    a, b = names.withColumnRenamed("name", "ln"), names.withColumnRenamed("name", "rn")
    pairs = a.join(b, ["candidate_type", "block"]).filter("ln <= rn").drop("block")
    pairs = pairs.withColumn("score", S.fuzzy_weighted("ln", "rn")).withColumn("threshold", S.fuzzy_threshold(F.col("ln"), F.col("rn"), threshold))
    pairs = pairs.filter("score >= threshold").withColumn("confidence", S.fuzzy_confidence(F.col("score"), F.col("threshold"), F.col("ln"), F.col("rn")))
    side = lambda key, name: c.select("candidate_type", F.col("candidate_key").alias(key), F.col("name").alias(name))
    met = pairs.join(side("k1", "ln"), ["candidate_type", "ln"]).join(side("k2", "rn"), ["candidate_type", "rn"]).filter("ln < rn or k1 < k2")
    out = met.filter("k1 <> k2").select(F.least("k1", "k2").alias("left"), F.greatest("k1", "k2").alias("right"), "candidate_type", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))
    return out if most is None else out.orderBy(F.desc("confidence"), "left", "right").limit(most)


def semantic_suggestions(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """left, right, candidate_type, score, confidence of similar embeddings (left, right, similarity), as fuzzy_suggestions has them."""
    kinds = candidates.select(F.col("candidate_key").alias("left"), "candidate_type")
    return pairs.join(kinds, "left").select("left", "right", "candidate_type", F.round("similarity", 6).alias("score"), F.round(F.least(F.lit(1.0), F.col("similarity")), 6).alias("confidence"))


def suggestions(fuzzy: DataFrame, semantic: DataFrame, most: int | None = 100) -> DataFrame:
    """Both kinds of suggestions as one bag, with the method, ranked by confidence."""
    both = fuzzy.withColumn("method", F.lit("fuzzy")).unionByName(semantic.withColumn("method", F.lit("semantic")))
    return both if most is None else both.orderBy(F.desc("confidence"), "left", "right", "method").limit(most)


def top_choices(sources: DataFrame, choices: DataFrame, k: int = 3, threshold: float = 0.9) -> DataFrame:
    """Best k choices of each source name; every distinct choice is scored, as the best k have no least score."""
    a = sources.select(F.lower(F.trim("name")).alias("source")).distinct()
    b = choices.select(F.lower(F.trim("name")).alias("choice")).distinct()
    scored = a.crossJoin(b).withColumn("score", S.fuzzy_weighted("source", "choice")).withColumn("passed", F.col("score") >= S.fuzzy_threshold(F.col("source"), F.col("choice"), threshold))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(F.desc("score"), "choice"))).filter(F.col("rank") <= k)


def node_weights(edges: DataFrame, top: int = 75) -> DataFrame:
    both = edges.select(F.col("left").alias("node"), "n").union(edges.select("right", "n"))
    return both.groupBy("node").agg(F.sum("n").alias("weight")).orderBy(F.desc("weight"), "node").limit(top)


def cooccurrence_matrix(edges: DataFrame, top: int = 100) -> DataFrame:
    """Symmetric matrix of the heaviest nodes, one column a node; a report of at most `top` rows."""
    nodes = [r["node"] for r in node_weights(edges, top).collect()]
    both = edges.select("left", "right", "n").union(edges.select("right", "left", "n")).filter(F.col("left").isin(*nodes) & F.col("right").isin(*nodes))
    return both.groupBy(F.col("left").alias("node")).pivot("right", nodes).agg(F.sum("n")).na.fill(0).orderBy("node")


def dot_graph(edges: DataFrame, names: dict[str, str] | None = None, top: int = 75) -> str:
    """GraphViz text of the heaviest nodes; a report of bounded size."""
    names = names or {}
    nodes = {r["node"]: r["weight"] for r in node_weights(edges, top).collect()}
    quote = lambda s: '"' + str(names.get(s, s)).replace('"', "'") + '"'
    lines = ["graph cooccurrence {"] + [f"  {quote(n)} [weight={w}];" for n, w in sorted(nodes.items())]
    kept = edges.filter(F.col("left").isin(*nodes) & F.col("right").isin(*nodes)).orderBy(F.desc("n"), "left", "right")
    lines += [f"  {quote(r['left'])} -- {quote(r['right'])} [label={r['n']}];" for r in kept.collect()]
    return "\n".join([*lines, "}"])


def markdown_report(stats: dict, sections: dict[str, list[dict]]) -> str:
    lines = ["# Discovery report", ""] + [f"- {k}: {v}" for k, v in stats.items()]
    for title, rows in sections.items():
        lines += ["", f"## {title}", ""]
        if not rows:
            lines.append("none")
            continue
        cols = list(rows[0])
        lines += ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
        lines += ["| " + " | ".join(str(r[c]).replace("|", "\\|") for c in cols) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def html_report(stats: dict, sections: dict[str, list[dict]]) -> str:
    from html import escape

    out = ["<!doctype html><meta charset=utf-8><title>Discovery report</title><h1>Discovery report</h1><ul>"]
    out += [f"<li>{escape(str(k))}: {escape(str(v))}</li>" for k, v in stats.items()] + ["</ul>"]
    for title, rows in sections.items():
        out.append(f"<h2>{escape(title)}</h2><table>")
        if rows:
            out.append("<tr>" + "".join(f"<th>{escape(c)}</th>" for c in rows[0]) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r.values()) + "</tr>" for r in rows] + ["</table>"]
    return "".join(out)
