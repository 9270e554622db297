"""The discovery run: report tables, and the files made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import candidates as K
from ..operators import curation as U
from ..operators import discovery as D
from ..operators import graph as G
from ..operators import vectors as V


def discover(candidates: DataFrame, entities: DataFrame | None = None, cap: int = 50, least: int = 2, edges: int = 500, clusters: int = 50, suggestions: int = 100) -> dict[str, DataFrame]:
    """Report tables over the candidates that aren't an approved entity already."""
    resolved = None
    if entities is not None:
        marked = U.pre_resolve(candidates, U.approved_lookup(entities))
        resolved = marked.filter("entity_id is not null").select("candidate_key", "entity_id", "reason")
        candidates = marked.filter("entity_id is null").drop("entity_id", "reason")
    pairs = candidates.select(F.explode("chunk_ids").alias("chunk_id"), F.col("candidate_key").alias("key"))
    co = D.cooccurrence(pairs, cap, least, edges)
    out = {
        "statistics": K.corpus_statistics(candidates),
        "types": K.type_counts(candidates, "candidate_type"),
        "top_entities": K.top_entities(candidates).select("candidate_key", "canonical_name", "mention_count", "confidence_score"),
        "cooccurrence": co,
        "clusters": D.components(co, clusters),
        "unknown_types": K.unknown_types(candidates, list(C.ENTITY_TYPES)),
        "merge_suggestions": D.suggestions(D.fuzzy_suggestions(candidates, most=None), semantic(candidates), suggestions),
    }
    return out if resolved is None else out | {"resolved": resolved}


def points(candidates: DataFrame) -> DataFrame:
    """Candidates as vectors of their deduplication text."""
    return candidates.select(F.col("candidate_key").alias("id"), F.col("candidate_type").alias("entity_type"), V.hashed_embedding(V.entity_text(F.col("canonical_name"), F.col("aliases"), F.col("description"))).alias("vec"))


def semantic(candidates: DataFrame, threshold: float = 0.85) -> DataFrame:
    return D.semantic_suggestions(V.similar_pairs(points(candidates), threshold).select("left", "right", "similarity"), candidates)


def merges(candidates: DataFrame, threshold: float) -> DataFrame:
    """candidate_key, survivor of the clusters whose members' names are alike by at least the threshold."""
    pairs = D.fuzzy_suggestions(candidates, most=None).filter(F.col("score") >= threshold)
    return U.survivors(G.connected_components(pairs), candidates)


def deduplicate(candidates: DataFrame, threshold: float = 0.95, rounds: int = 10) -> DataFrame:
    """Automatic merging until no two candidates of a type are alike by the threshold, in embedding and type."""
    auto = lambda c: V.similar_pairs(points(c), threshold).filter("lt = rt")
    return U.auto_merge(candidates, auto, rounds)


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """Report files on the driver; every table in them is a top list of bounded size."""
    import json
    import os

    os.makedirs(folder, exist_ok=True)
    stats = tables["statistics"].first().asDict()
    sections = {k: [r.asDict() for r in tables[k].limit(500).collect()] for k in ("types", "top_entities", "cooccurrence", "unknown_types", "merge_suggestions")}
    for name, text in (("report.md", D.markdown_report(stats, sections)), ("report.html", D.html_report(stats, sections)), ("graph.dot", D.dot_graph(tables["cooccurrence"])), ("report.json", json.dumps({"statistics": stats} | sections, default=str))):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)


def write_matrix(tables: dict[str, DataFrame], folder: str) -> None:
    """cooccurrence.csv: the matrix of the heaviest hundred candidates."""
    import os

    rows = D.cooccurrence_matrix(tables["cooccurrence"]).collect()  # a hundred rows at most
    lines = ([list(rows[0].asDict())] if rows else []) + [list(r) for r in rows]
    with open(os.path.join(folder, "cooccurrence.csv"), "w", encoding="utf-8") as f:
        f.writelines(",".join(map(str, line)) + "\n" for line in lines)
