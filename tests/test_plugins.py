"""Model plug-ins, normalisation files, rewriting, mention merging: what has no query."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import candidates as K
from tessera.operators import chunking as H
from tessera.operators import curation as U
from tessera.operators import extraction as E
from tessera.operators import normalization as N
from tessera.plans import ingestion
from tessera.sources import files


def test_replies_of_a_model():
    assert E.first_json('Sure: {"a": [1]} and more') == {"a": [1]} and E.first_json("[1, 2] x") == [1, 2] and E.first_json("no { json") is None
    got = E.entities_of('```json\n{"entities": [{"name": " Bus ", "type": "system", "aliases": "B, main", "confidence": 3}, {"entity": "X"}, {"type": "y"}]}```')
    assert got == [{"name": "Bus", "type": "SYSTEM", "aliases": ["B", "main"], "description": None, "confidence": 1.0}, {"name": "X", "type": "CONCEPT", "aliases": [], "description": None, "confidence": 0.5}]
    rels = E.relations_of('{"relationships": [{"from": "A", "to": "B", "type": "contains"}, {"source": "A", "target": "a", "type": "x"}, {"source": "A"}]}')
    assert rels == [{"source": "A", "target": "B", "type": "CONTAINS", "confidence": 0.5}]


def test_with_model_retries_and_gives_up(spark):
    df = spark.createDataFrame([("c1", "d", "good"), ("c2", "d", "flaky"), ("c3", "d", "bad")], "chunk_id string, document_id string, content string").coalesce(1)
    calls = {}

    def call(text):
        calls[text] = calls.get(text, 0) + 1
        if text == "bad" or (text == "flaky" and calls[text] < 3):
            raise RuntimeError("no answer")
        return json.dumps({"entities": [{"name": text}]})

    rows = E.with_model(df, call, "chunk_id string, document_id string, name string, confidence double", E.entities_of, retries=2).collect()
    assert sorted((r["chunk_id"], r["name"]) for r in rows) == [("c1", "good"), ("c2", "flaky")]


def test_normalisation_files(spark, tmp_path):
    now = F.lit("2024-01-02 03:04:05").cast("timestamp")
    t = spark.createDataFrame([("bus", ["Bus", "b|us"], "1", 'Main "Bus"', "SYSTEM", "manual", 0.5, 2, "n", "s", "approved")], "normalized_form string, raw_variants array<string>, canonical_id string, canonical_name string, entity_type string, method string, confidence double, version int, notes string, source string, status string").withColumns({"created_at": now, "updated_at": now})
    N.export_csv(t, str(tmp_path / "csv"))
    back = N.import_csv(spark, str(tmp_path / "csv")).first()
    assert back["canonical_name"] == 'Main "Bus"' and back["raw_variants"] == ["Bus", "b", "us"] and back["version"] == 2 and back["confidence"] == 0.5
    N.export_json(t, str(tmp_path / "json"))
    assert N.import_json(spark, str(tmp_path / "json")).first()["raw_variants"] == ["Bus", "b|us"]


def test_rewrites_that_lose_something_are_refused(spark):
    c = spark.createDataFrame([("1", "Unit 42 of ABC"), ("2", "plain words")], "chunk_id string, content string")
    new = ingestion.rewriting(lambda t: F.when(t.contains("42"), F.lit("Unit of ABC")).otherwise(F.upper(t)))({"chunks": c})["chunks"]
    assert {(r["chunk_id"], r["content"], r["lost"]) for r in new.collect()} == {("1", "Unit 42 of ABC", "numbers"), ("2", "PLAIN WORDS", None)}


def test_alias_chains_are_one_candidate(spark):
    m = [("c", "Attitude Control Unit", ["ACU"], 0.9, "llm"), ("c", "ACU", ["the box"], 0.6, "spacy"), ("c", "the box", [], 0.5, "spacy"), ("d", "ACU", [], 0.5, "spacy")]
    df = spark.createDataFrame([(c, "doc", n, "COMPONENT", a, f, s, None) for c, n, a, f, s in m], "chunk_id string, document_id string, name string, type string, aliases array<string>, confidence double, source string, description string")
    got = {(r["chunk_id"], r["canonical_name"], r["mention_count"]) for r in K.merge_mentions(df, F.lower("name")).collect()}
    assert got == {("c", "Attitude Control Unit", 3), ("d", "ACU", 1)}


@pytest.mark.parametrize("most", [3, 5, 100])
def test_sentences_are_packed_with_two_carried_over(spark, most):
    text = " ".join(f"{'w ' * n}end." for n in (1, 2, 1, 3, 1, 1, 2, 6, 1))
    said = text.replace(". ", ".|").split("|")
    size = lambda s: int(len(s.split()) * 1.3)
    want, buf = [], []
    for s in said:
        if buf and sum(map(size, buf)) + size(s) > most:
            want.append((" ".join(buf), sum(map(size, buf))))
            buf = buf[-2:]
        buf.append(s)
    want.append((" ".join(buf), sum(map(size, buf))))
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(H.pack_sentences(F.col("t"), most).alias("p"))
    rows = [r["p"] for r in df.collect()]
    assert [(x["content"], x["token_count"]) for x in rows[0]] == want and not rows[1] and not rows[2]


def test_undo_takes_back_within_a_session(spark):
    c = spark.createDataFrame([(k, "pending") for k in "abc"], "candidate_key string, status string")
    log = spark.createDataFrame([(1, "x", "a", "approve"), (2, "y", "b", "reject"), (3, "x", "c", "approve"), (4, "x", None, "undo"), (5, "x", None, "undo"), (6, "y", "a", "reject")], "seq int, session string, candidate_key string, action string")
    state = lambda n: {r[0]: r[1] for r in U.replay(c, log, n).collect()}
    assert state(None) == {"a": "rejected", "b": "rejected", "c": "pending"} and state(4) == {"a": "approved", "b": "rejected", "c": "pending"}
    whole = {r[0]: r[1] for r in U.replay(c, log.drop("session"), 5).collect()}
    assert whole == {"a": "approved", "b": "pending", "c": "pending"}


def test_small_functions(spark):
    row = spark.range(1).select(
        files.pdf_date(F.lit("D:20240102030405")).alias("a"), files.pdf_date(F.lit("x")).alias("b"), X.truncate_words(F.lit("one two three"), 2).alias("c"), X.ascii_bar(F.lit(1), F.lit(0)).alias("d")
    ).first()
    assert tuple(row) == ("2024-01-02", None, "one two...", "") and files.deep_merge({"a": {"b": 1}}, {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}}
