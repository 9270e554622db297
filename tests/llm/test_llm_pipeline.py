"""The pipeline against brute force, stage by stage, on the smallest tables."""

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_llm_operators import slow_components, slow_fingerprint, words
from tessera.llm import queries

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r["doc_id"]: r["text"] for r in corpus_pipeline.language(spark, docs, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(any(map(str.isalpha, t or "")) for t in known.values()) and len(known) >= 0.97 * len(texts)
    last = {}
    for i, t in known.items():
        last[t or ""] = max(last.get(t or "", i), i)
    left = {i: known[i] for i in last.values()}
    ids = sorted(left)
    comp = slow_components([slow_fingerprint(left[i]) for i in ids], ids)
    left = {i: left[i] for i, c in zip(ids, comp) if i == c}
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        ws = words(r["text"])
        n = min(13, len(ws))
        for a in range(len(ws) - n + 1) if n else ():
            windows.setdefault(n, set()).add(tuple(ws[a : a + n]))
    for i in list(left):
        ws, hit = words(left[i]), set()
        for n, wins in windows.items():
            for a in range(len(ws) - n + 1):
                if tuple(ws[a : a + n]) in wins:
                    hit |= set(range(a, a + n))
        if hit and 20 * len(hit) >= len(ws):
            del left[i]
    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in left.items()}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r["doc_tokens"] == want[r["doc_id"]]
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    import glob
    import os

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    show = lambda v: f"{v:.6g}" if isinstance(v, (float, np.floating)) else str(v)
    got = sorted(tuple(show(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(queries.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(show(r[i]) for i in at) for r in rel.fetchall())


def test_language_accuracy_held_out(spark):
    """At least 97 of 100 held-out documents get their language."""
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op10_language_id(spark, sf).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) >= 0.97
