import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as X
from tessera.operators import candidates as K
from tessera.operators import chunking as H
from tessera.operators import curation as U
from tessera.operators import discovery as D
from tessera.operators import extraction as E
from tessera.operators import graph as G
from tessera.operators import retrieval as R
from tessera.operators import update as P
from tessera.operators import vectors as V

MENTION = "chunk_id string, document_id string, name string, type string, description string, aliases array<string>, confidence double, source string"


def merge(spark, rows, allowed=None):
    return K.merge_mentions(spark.createDataFrame(rows, MENTION), X.normalize_name("name"), allowed).collect()


def test_merge_two_extractors(spark):
    (r,) = merge(spark, [("c", "d", "Star Tracker", "COMPONENT", None, [], 0.6, "spacy"), ("c", "d", "star tracker", "COMPONENT", None, [], 0.82, "llm")])
    assert r["mention_count"] == 2 and r["confidence"] > 0.82


def test_merge_type_conflict(spark):
    (r,) = merge(spark, [("c", "d", "Bus", "SYSTEM", None, [], 0.7, "spacy"), ("c", "d", "bus", "COMPONENT", None, [], 0.55, "llm")])
    assert r["type"] == "SYSTEM" and r["conflicting_types"] == ["COMPONENT"] and r["confidence"] == pytest.approx(1 - 0.3 * 0.45 + 0.05 if 1 - 0.3 * 0.45 + 0.05 < 1 else 1)


def test_merge_alias_bridge_and_chunks(spark):
    rows = [("c", "d", "Electrical Power System", "SYSTEM", None, [], 0.6, "spacy"), ("c", "d", "electrical power system", "SYSTEM", None, ["EPS"], 0.8, "llm"), ("c", "d", "EPS", "SYSTEM", None, [], 0.6, "spacy"), ("c2", "d", "EPS", "SYSTEM", None, [], 0.6, "spacy")]
    got = merge(spark, rows)
    assert sorted(r["mention_count"] for r in got) == [1, 3]
    assert merge(spark, rows, ("COMPONENT",)) == []


def test_upsert_is_a_fold(spark):
    cols = "candidate_key string, canonical_name string, mention_count long, confidence_score double, source_documents array<string>, first_seen timestamp, last_seen timestamp"
    mk = lambda *rows: spark.createDataFrame(rows, cols)
    from datetime import datetime

    t = datetime(2024, 1, 1)
    one = K.upsert_candidates(None, mk(("k", "First", 2, 0.5, ["a"], t, t)))
    two = K.upsert_candidates(one, mk(("k", "Second", 3, 0.9, ["a", "b"], t, t), ("n", "New", 1, 0.1, None, t, t)))
    got = {r["candidate_key"]: r for r in two.collect()}
    assert (got["k"]["canonical_name"], got["k"]["mention_count"], got["k"]["confidence_score"], got["k"]["source_documents"]) == ("First", 5, 0.9, ["a", "b"])
    assert got["n"]["source_documents"] == []


def test_cooccurrence_and_clusters(spark):
    pairs = spark.createDataFrame([("c1", "A"), ("c1", "B"), ("c2", "A"), ("c2", "C")], "chunk_id string, key string")
    assert {(r["left"], r["right"]): r["n"] for r in D.cooccurrence(pairs, least=1).collect()} == {("A", "B"): 1, ("A", "C"): 1}
    two = spark.createDataFrame([("c1", "A"), ("c1", "B"), ("c2", "C"), ("c2", "D")], "chunk_id string, key string")
    comp = G.connected_components(D.cooccurrence(two, least=1)).collect()
    assert {r["node"]: r["component"] for r in comp} == {"A": "A", "B": "A", "C": "C", "D": "C"}
    assert "A" in D.dot_graph(D.cooccurrence(two, least=1)) and D.cooccurrence_matrix(D.cooccurrence(two, least=1)).count() == 4


def test_trails_use_an_edge_once(spark):
    e = spark.createDataFrame([("1", "a", "b", "X"), ("2", "b", "a", "X"), ("3", "a", "b", "X"), ("4", "b", "c", "Y")], "id string, source_entity_id string, target_entity_id string, type string")
    s = spark.createDataFrame([("a",)], "id string")
    got = {(r["end"], r["depth"]) for r in G.traverse(e, s, 3).collect()}
    assert got == {("b", 1), ("a", 2), ("c", 2), ("b", 3)}
    pairs = spark.createDataFrame([("a", "c")], "source string, target string")
    assert [r["depth"] for r in G.find_paths(e, pairs, 2).orderBy("rank").collect()] == [2, 2, 2]


def test_components_of_a_chain_and_a_star(spark):
    rows = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1040)]
    got = {r["node"]: r["component"] for r in G.connected_components(spark.createDataFrame(rows, "left long, right long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 101


def test_vector_clusters(spark):
    rows = [("x", "X one", "T", "", 5, [1.0, 0.0]), ("y", "Y", "T", "", 2, [0.99, 0.01]), ("z", "Z", "T", "", 1, [0.0, 1.0]), ("w", "W", "U", "", 1, [1.0, 0.0])]
    p = spark.createDataFrame(rows, "id string, name string, entity_type string, description string, mention_count long, vec array<double>")
    pairs = V.similar_pairs(p)
    (s,) = V.merge_suggestions(pairs, V.clusters(pairs, p), p).collect()
    assert (s["source"], s["target"], s["auto_merge"]) == ("x", "y", True)


def test_fusion(spark):
    h = spark.createDataFrame([("q", "a", 0.9, 0.7, 0.8, 0.85), ("q", "b", 0.9, None, 0.0, 0.5)], "query_id string, chunk_id string, vector_score double, graph_score double, entity_coverage_score double, confidence_score double")
    got = {r["chunk_id"]: r["final_score"] for r in R.fuse(h).collect()}
    assert got["a"] == pytest.approx(0.815789, abs=1e-6) and got["b"] == pytest.approx(0.630769, abs=1e-6)


def test_min_max(spark):
    h = spark.createDataFrame([("a", 0.9), ("a", 0.7), ("a", 0.5), ("b", 0.75), ("c", 0.8), ("c", 0.8)], "query_id string, score double")
    got = sorted((r[0], round(r[1], 6)) for r in h.select("query_id", R.min_max("score")).collect())
    assert got == [("a", 0.0), ("a", 0.5), ("a", 1.0), ("b", 1.0), ("c", 1.0), ("c", 1.0)]


def test_mmr_prefers_what_differs(spark):
    h = spark.createDataFrame([("q", "1", 0.9, "red green blue"), ("q", "2", 0.89, "red green blue"), ("q", "3", 0.6, "one two three")], "query_id string, chunk_id string, score double, content string")
    assert [r["chunk_id"] for r in R.mmr(h).orderBy("mmr_rank").collect()] == ["1", "3", "2"]


DOC = "# One\nIntro.\n## Sub\nDetails about the bus.\n# Two\n" + "A sentence with seven words in it. " * 120


def test_chunks(spark):
    d = spark.createDataFrame([("d", DOC, "/x/guide.md"), ("p", "plain text " * 20, "/x/p.txt"), ("s", "## Only\nsub", "/x/stem.md")], "document_id string, raw_text string, file_path string")
    rows = H.chunk_documents(d).collect()
    of = lambda doc, level: {r["hierarchy_path"]: r for r in rows if r["document_id"] == doc and r["level"] == level}
    assert {k: v["section_title"] for k, v in of("d", 2).items()} == {"1": "One", "2": "Two"}
    assert of("d", 3)["1.1"]["content"] == "Details about the bus." and of("d", 3)["1.1"]["parent_chunk_id"] == of("d", 2)["1"]["chunk_id"]
    packed = of("d", 4)
    assert list(packed) == ["2.1.1", "2.1.2", "2.1.3"] and all(r["token_count"] <= 512 for r in packed.values())
    assert of("p", 1) and list(of("p", 4)) == ["1"] and of("s", 2)["1"]["section_title"] == "stem"


def test_relations(spark):
    c = spark.createDataFrame([("c", "d", "A solar panel is a type of power source. The OBC controls the power unit. X controls x.")], "chunk_id string, document_id string, content string")
    got = {(r["source"], r["type"], r["target"]) for r in E.pattern_relations(c).collect()}
    assert got == {("A solar panel", "IS_A", "power source"), ("The OBC", "CONTROLS", "the power unit")}
    m = spark.createDataFrame([("c", "solar panel"), ("c", "power source"), ("c", "OBC")], "chunk_id string, name string")
    why = {r["type"]: r["reason"] for r in E.validate_relations(E.pattern_relations(c), m).collect()}
    assert why == {"IS_A": None, "CONTROLS": "source not known"}


def test_acronyms(spark):
    c = spark.createDataFrame([("1", "Telemetry and Command (T&C) is used."), ("2", "PDU (Power Distribution Unit) here."), ("3", "Protocol Data Unit (PDU) frames.")], "chunk_id string, content string")
    d = E.acronym_dictionary(E.acronym_definitions(c))
    assert {(r["acronym"], r["expansion"]) for r in d.collect()} == {("T&C", "Telemetry and Command"), ("PDU", "Power Distribution Unit"), ("PDU", "Protocol Data Unit")}
    asked = spark.createDataFrame([("a", "PDU", "PDU frames"), ("b", "NASA", "")], "id string, acronym string, context string")
    got = {r["id"]: r["expansion"] for r in E.resolve_acronyms(asked, d).collect()}
    assert got == {"a": "Protocol Data Unit", "b": "National Aeronautics and Space Administration"}


def test_changes(spark):
    scan = spark.createDataFrame([("/a/1", "s1"), ("/a/2", "s2x"), ("/b/3", "s3"), ("/a/5", "s5"), ("/a/copy", "s1")], "path string, checksum string")
    cat = spark.createDataFrame([("1", "/a/1", "s1", "t"), ("2", "/a/2", "s2", "t"), ("3", "/a/3", "s3", "t"), ("4", "/a/4", "s4", "t"), ("9", "/z/9", "s9", "t")], "id string, file_path string, checksum string, last_ingested_at string")
    got = {r["path"]: (r["status"], r["document_id"], r["old_path"]) for r in P.detect_changes(scan, cat, ["/a", "/b"]).collect()}
    assert got == {"/a/1": ("unchanged", "1", None), "/a/2": ("modified", "2", None), "/b/3": ("renamed", "3", "/a/3"), "/a/4": ("deleted", "4", None), "/a/5": ("new", None, None), "/a/copy": ("new", None, None)}


def test_undo_takes_back_the_latest_live_decision(spark):
    c = spark.createDataFrame([("a", "A", "pending"), ("b", "B", "pending"), ("c", "C", "pending")], "candidate_key string, canonical_name string, status string")
    log = [(1, "a", "approve", None), (2, "b", "reject", None), (3, "c", "edit", "See"), (4, None, "undo", None), (5, None, "undo", None), (6, "c", "approve", None)]
    state = lambda n: {r["candidate_key"]: (r["canonical_name"], r["status"]) for r in U.replay(c, spark.createDataFrame(log, "seq int, candidate_key string, action string, canonical_name string"), n).collect()}
    assert state(3) == {"a": ("A", "approved"), "b": ("B", "rejected"), "c": ("See", "pending")}
    assert state(5) == {"a": ("A", "approved"), "b": ("B", "pending"), "c": ("C", "pending")}
    assert state(None)["c"] == ("C", "approved")


def test_merge_into_entity(spark):
    e = spark.createDataFrame([("E", "Motor", "COMPONENT", ["m"], "", 0.5, "approved", 10, ["d"], ["c"], "k0", ["k0"])], schemas.struct("entities"))
    c = spark.createDataFrame([("k1", "AC Motor", 5, 0.9, ["acm"], "drives", ["d2"], ["c2"], "E")], "candidate_key string, canonical_name string, mention_count long, confidence_score double, aliases array<string>, description string, source_documents array<string>, chunk_ids array<string>, entity_id string")
    (r,) = U.merge_into_entity(e, c).collect()
    assert r["mention_count"] == 15 and "AC Motor" in r["aliases"] and r["merged_candidate_keys"] == ["k0", "k1"] and r["description"] == "drives"


def test_strict_append_raises(spark):
    a = spark.createDataFrame([("x", 1)], "id string, v int")
    with pytest.raises(Exception, match="duplicate key x"):
        K.append_strict(a, a, "id").collect()
    assert K.append_strict(a, a.withColumn("id", F.lit("y")), "id").count() == 2
