"""The rerankers against brute force on the whole texts."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.plans import registry, vector_queries

SF = "/root/testdata/sf0.001"


def alike(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def pages(rows, score):
    texts = {r["doc_id"]: set((r["text"] or "").lower().split()) for r in rows[0]}
    by = {}
    for r in rows[1]:
        by.setdefault(r["query_id"], []).append((r[score], r["chunk_id"]))
    return texts, {q: sorted(v, key=lambda x: (-x[0], x[1])) for q, v in by.items()}


def chosen(page, texts, gain):
    left, out = list(page), []
    while left:
        near = lambda x: max((alike(texts[x[1]], texts[y[1]]) for y, _ in out), default=0.0)
        best = left[0] if not out else max(left, key=lambda x: (gain(x[0], near(x)), -page.index(x)))
        out.append((best, near(best)))
        left.remove(best)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()


def test_mmr_takes_whole_texts(spark, docs):
    hits = vector_queries.hits(spark, SF).select("query_id", "chunk_id", "score").collect()
    texts, by = pages((docs, hits), "score")
    by = {q: [x for x in v if x[1] in texts] for q, v in by.items()}
    want = {(q, x[1]): n for q, v in by.items() for n, (x, _) in enumerate(chosen(v, texts, lambda s, n: 0.5 * s - 0.5 * n), 1)}
    got = {(r["query_id"], r["chunk_id"]): r["mmr_rank"] for r in registry.queries()["mmr_rerank"](spark, SF).collect()}
    assert got and got == want


def test_diversity_takes_whole_texts(spark, docs):
    known = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("chunk_id"))
    fused = R.fuse(vector_queries.signals(vector_queries.hits(spark, SF).drop("rank").join(known, "chunk_id"))).collect()
    texts, by = pages((docs, fused), "final_score")
    want = {}
    for q, page in by.items():
        rows = [(x[1], x[0] if not i else 0.95 * x[0] + 0.05 * (1 - n), 1 - n) for i, (x, n) in enumerate(chosen(page, texts, lambda s, n: 0.95 * s + 0.05 * (1 - n)))]
        want |= {(q, c): (pytest.approx(s, abs=1e-5), pytest.approx(d, abs=1e-5)) for c, s, d in sorted(rows, key=lambda x: -x[1])[:10]}
    got = {(r["query_id"], r["chunk_id"]): (r["final_score"], r["diversity_score"]) for r in registry.queries()["diversity_rerank"](spark, SF).collect()}
    assert got and got == want
