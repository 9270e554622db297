"""Answering questions: hybrid retrieval over the store, and the iterative research loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import query as Q
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import search as B
from ..operators import vectors as V


def resolved(said: DataFrame, entities: DataFrame, entity_vectors: DataFrame | None = None) -> DataFrame:
    """Mentions (query_id, mention, normalized) -> entities: by name, else full text, else vector.

    Full-text scores are brought to 0..1 by the best hit of each mention.
    """
    asked = said.select(F.concat_ws("|", "query_id", "mention").alias("m"), "query_id", "mention").distinct()
    key = asked.withColumnRenamed("m", "_m")
    missing = {c: F.lit(None).cast(t) for c, t in (("aliases", "array<string>"), ("description", "string")) if c not in entities.columns}
    entities = entities.withColumns(missing) if missing else entities
    text = B.search_entities(entities, asked.select(F.col("m").alias("query_id"), F.col("mention").alias("text")), limit=3)
    text = text.withColumn("score", F.col("score") / F.max("score").over(W.partitionBy("query_id"))).withColumnsRenamed({"query_id": "_m", "id": "entity_id"})
    text = text.join(key, "_m").select("query_id", "mention", "entity_id", "score")
    near = None
    if entity_vectors is not None:
        hits = V.knn(entity_vectors, asked.select(F.col("m").alias("query_id"), V.hashed_embedding(F.col("mention")).alias("vec")), k=3, least=0.75)
        near = hits.withColumnsRenamed({"query_id": "_m", "id": "entity_id"}).join(key, "_m").select("query_id", "mention", "entity_id", "score")
    return G.resolve_mentions(said, entities, text, near)


def walked(q: DataFrame, hits: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """query_id, entity_id, end, depth, score, path: what the entities of each question reach.

    Each question's own strategy, depth and types decide: hierarchies go down, sequences both
    ways, the others both ways over the types asked for, where edges have them; a question
    whose types no edge has reaches nothing.
    """
    there = G.existing_types(edges)
    wanted = q.select("query_id", F.explode_outer("relationship_types").alias("type"))
    kept = wanted.join(there, "type").groupBy("query_id").agg(F.collect_set("type").alias("types"))
    plan = q.select("query_id", "traversal", F.least("max_depth", F.lit(depth)).alias("most"), (F.size("relationship_types") > 0).alias("typed")).join(kept, "query_id", "left")
    starts = hits.select("query_id", "entity_id", "score").join(plan.filter(~F.col("typed") | F.col("types").isNotNull()), "query_id")
    out = None
    for strategy in ("hierarchical", "sequential", "procedural", "multi_hop"):
        named = F.col("traversal") == strategy if strategy != "multi_hop" else F.col("traversal").isin("multi_hop", "shortest_path")
        some = starts.filter(named)
        t = G.strategy_paths(edges, some.select(F.col("entity_id").alias("id")).distinct(), strategy, depth)
        kinds = t.select("*", F.explode("eids").alias("_eid")).join(edges.select(F.col("id").cast("string").alias("_eid"), "type"), "_eid").groupBy("start", "end", "depth", "nodes", "eids").agg(F.collect_set("type").alias("used"))
        j = some.join(kinds, some["entity_id"] == kinds["start"]).filter(F.col("depth") <= F.col("most"))
        if strategy == "multi_hop":
            j = j.filter(~F.col("typed") | (F.size(F.array_except("used", "types")) == 0))
        far = F.when(F.element_at("nodes", 1) == F.col("entity_id"), F.col("end")).otherwise(F.element_at("nodes", 1))
        rows = j.select("query_id", "entity_id", far.alias("end"), "depth", "score", F.array_join("nodes", ">").alias("path"))
        out = rows if out is None else out.unionByName(rows)
    return out


def retrieve(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, entities: DataFrame, edges: DataFrame, top: int = 10, depth: int = 3, topics: DataFrame | None = None, entity_vectors: DataFrame | None = None) -> DataFrame:
    """questions (query_id, text) -> ranked chunks with scores and source; a batch of questions is one plan.

    Vector side: nearest chunks of the embedded question. Graph side: entities named in the
    question, what they reach by the question's strategy, depth and types, and the chunks of
    that. Questions that need no graph have the vector side alone. topics (query_id,
    document_id) restricts the vector side.
    """
    q = Q.parse(questions)
    asked = q.select("query_id", V.hashed_embedding(F.col("normalized_text")).alias("vec"))
    near = V.knn(vectors.select(F.col("chunk_id").alias("id"), "vec"), asked, k=20, least=None).withColumnRenamed("id", "chunk_id")
    if topics is not None:
        near = near.join(vectors.select("chunk_id", "document_id"), "chunk_id").join(topics, ["query_id", "document_id"], "left_semi").drop("document_id")
    vector = near.withColumn("vector_score", R.min_max("score")).select("query_id", "chunk_id", "vector_score", F.lit(0.0).alias("entity_coverage_score"), F.lit(0.5).alias("confidence_score"))
    said = q.select("query_id", F.explode("entity_mentions").alias("mention")).withColumn("normalized", F.lower(F.trim("mention")))
    hits = G.written(resolved(said, entities, entity_vectors), "resolved")
    own = hits.select("query_id", "entity_id", F.col("entity_id").alias("end"), F.lit(0).alias("depth"), "score", F.col("entity_id").alias("path"))
    reached = walked(q.filter("strategy <> 'vector_only'"), hits, edges, depth)
    scored = own.unionByName(reached).withColumn("score", G.path_score(F.col("depth"), F.col("score"), F.col("score") * 0.9))
    members = entities.select(F.col("id").alias("end"), "chunk_ids")
    through = scored.join(members, "end").select("query_id", "path", "score", "chunk_ids", "end")
    of = through.select("query_id", "end", F.explode("chunk_ids").alias("chunk_id")).groupBy("query_id", "chunk_id").agg(F.collect_set("end").alias("entity_ids"))
    wanted = hits.groupBy("query_id").agg(F.collect_set("entity_id").alias("entity_ids"))
    graph = R.chunk_graph_scores(of, through.select("query_id", "path", "score", "chunk_ids"), wanted)
    fused = R.fuse(R.merge_hits(vector, graph)).join(chunks.select("chunk_id", "document_id", "content"), "chunk_id")
    first = R.rank_by(fused, top=2 * top)
    ranked = R.diversify(first, top=top)
    return ranked.join(first.select("query_id", "chunk_id", "document_id", "content", "source", "vector_score", "graph_score"), ["query_id", "chunk_id"])


def research(question: str, search: Callable[[str, int], list[dict]], enough: Callable[[str, list[dict]], tuple[bool, str]], ask_more: Callable[[str, str], list[str]], answer: Callable[[str, list[dict]], str], rounds: int = 3, first: int = 10, more: int = 5) -> dict:
    """Search, judge, ask sub-questions, until enough is known, nothing more is asked or nothing new is found.

    The callables are plug-ins; search returns at most k rows with chunk_id, content, final_score.
    """
    found = {r["chunk_id"]: r for r in search(question, first)}
    steps = []
    for i in range(rounds):
        ok, missing = enough(question, list(found.values()))
        steps.append({"round": i + 1, "chunks": len(found), "sufficient": ok})
        if ok:
            break
        subs = ask_more(question, missing)
        fresh = [r for s in subs for r in search(s, more) if r["chunk_id"] not in found]
        if not subs or not fresh:
            break
        for r in fresh:
            found.setdefault(r["chunk_id"], r)
    best = sorted(found.values(), key=lambda r: -r["final_score"])[:5]
    text = answer(question, best)
    mean = sum(r["final_score"] for r in best) / len(best) if best else 0.0
    if len(text.split()) < 10:
        mean *= 0.5
    if any(p in text.lower() for p in C.REFUSALS):
        mean *= 0.2
    return {"answer": text, "confidence": max(0.0, min(1.0, mean)), "chunks": best, "steps": steps}


def ask(spark, store, text: str, mode: str = "auto", top: int = 5) -> dict:
    """One question over a store: retrieval, or the research loop for a complex question (auto) or always (deep).

    Offline stand-ins for a language model: the answer quotes the best chunks; enough is
    known when a chunk scores 0.6 or three rounds are over; sub-questions are the
    question's keywords. The parsed question goes to the store's log.
    """
    if mode not in ("auto", "deep", "simple"):
        raise ValueError(f"unknown mode {mode}")
    frame = lambda t: spark.createDataFrame([("q", t)], "query_id string, text string")
    parsed = Q.parse(frame(text)).select(Q.query_id(F.col("text"), F.current_timestamp()).alias("query_id"), F.col("text").alias("original_text"), "intent", "intent_confidence", "entity_mentions", "keywords", "requires_graph_traversal", F.current_timestamp().alias("timestamp"), "is_complex")
    parsed = G.written(parsed, "question")
    store.append_log("queries", parsed.drop("is_complex"))
    told = parsed.first()
    chunks, vectors, entities, edges = (store.read(t) for t in ("chunks", "chunk_vectors", "entities", "relationships"))

    def search(t: str, k: int) -> list[dict]:
        hits = retrieve(frame(t), chunks, vectors, entities, edges, top=k)
        return [r.asDict() for r in hits.orderBy("rank").collect()]  # k rows

    quote = lambda q, rows: "\n\n".join(f"[{i}] {r['content'][:500]}" for i, r in enumerate(rows, 1)) or "The store does not have enough information."
    if mode == "deep" or (mode == "auto" and told["is_complex"]):
        enough = lambda q, rows: (any(r["final_score"] >= 0.6 for r in rows), q)
        out = research(text, search, enough, lambda q, missing: list(told["keywords"])[:3], quote, first=2 * top, more=top)
        return out | {"mode": "deep"}
    rows = search(text, top)
    mean = sum(r["final_score"] for r in rows) / len(rows) if rows else 0.0
    return {"answer": quote(text, rows), "confidence": mean, "chunks": rows, "steps": [], "mode": "simple"}
