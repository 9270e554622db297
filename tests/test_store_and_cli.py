"""The store, rule files, the command line and the runs over them, end to end on a small folder."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import cli, rules, schemas
from tessera.functions import text as X
from tessera.operators import candidates as K
from tessera.operators import curation as U
from tessera.operators import vectors as V
from tessera.plans import discovery_run, ingestion, research, update_run
from tessera.sources import files
from tessera.sources.store import Store, by_key

ONE = "# Power\nThe power supply unit feeds the bus. The motor controller monitors the battery and the temperature sensor of the power supply unit.\n"
TWO = "# Control\nThe onboard computer controls the reaction wheel. The onboard computer monitors the star tracker near the sun sensor and gyroscope.\n"


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("filled")
    src = base / "in"
    src.mkdir()
    (src / "one.md").write_text(ONE)
    (src / "two.md").write_text(TWO)
    (src / "bad.txt").write_bytes(b"caf\xe9 and the battery of the onboard computer\n")
    store = Store(spark, str(base / "store"))
    return src, store, ingestion.ingest(spark, str(src), store)


def test_bytes_that_are_no_utf8_are_replaced(filled):
    _, store, counts = filled
    assert counts == {"read": 3, "ingested": 3, "failed": 0}
    assert [r["raw_text"] for r in store.read("documents").filter("filename = 'bad.txt'").collect()][0].startswith("caf� and")


def test_approving_makes_entities_names_and_edges(spark, filled, capsys):
    _, store, _ = filled
    keys = [r["candidate_key"] for r in store.read("entity_candidates").collect()]
    assert "COMPONENT:onboard_computer" in keys
    rel = store.read("relationship_candidates").filter("type = 'MONITORS'").first()
    cli.main([store.root, "relationship", "approve", rel["candidate_key"]])
    assert "not approved" in capsys.readouterr().out
    cli.main([store.root, "batch-approve", "0.1", "--dry-run"])
    assert f"{len(keys)} candidates" in capsys.readouterr().out
    cli.main([store.root, "approve", "COMPONENT:onboard_computer", "--reason", "sure"])
    assert by_key(store.read("entities"), "COMPONENT:onboard_computer").count() == 1
    assert store.read("normalization").filter("normalized_form = 'onboard_computer' and status = 'approved'").count() == 1
    cli.main([store.root, "batch-approve", "0.1"])
    assert store.read("entities").count() == len(keys) == store.read("entity_candidates").filter("status = 'approved'").count()
    names = {r["id"] for r in store.read("entities").collect()}
    edges = store.read("relationships").collect()
    assert all(e["source_entity_id"] in names and e["target_entity_id"] in names for e in edges)
    events = store.log("audit", "at timestamp, event string, payload string").collect()
    assert any(e["event"] == "approve_candidate" and json.loads(e["payload"])["reason"] == "sure" for e in events) and any(e["event"] == "ingest" for e in events)
    cli.main([store.root, "undo"])
    assert "undone" in capsys.readouterr().out and store.read("entities").count() == 1


def test_verbs_that_show(filled, tmp_path, capsys):
    _, store, _ = filled
    for words in (["queue", "sort=name"], ["search", "computer"], ["show", "COMPONENT:battery"], ["stats"], ["health"], ["history"], ["normalization", "queue"], ["normalization", "stats"], ["relationship", "queue"]):
        cli.main([store.root, *words])
    out = capsys.readouterr().out
    assert "onboard" in out and "COMPONENT:battery" in out and "'chunks': True" in out
    cli.main([store.root, "discover", str(tmp_path / "report")])
    assert (tmp_path / "report" / "cooccurrence.csv").exists()
    with pytest.raises(ValueError):
        cli.main([store.root, "queue", "colour=red"])


def test_edit_clears_and_sets(filled):
    _, store, _ = filled
    cli.main([store.root, "edit", "COMPONENT:battery", "canonical_name=Main battery", "description="])
    row = by_key(store.read("entity_candidates"), "COMPONENT:battery").first()
    assert (row["canonical_name"], row["description"]) == ("Main battery", None)
    with pytest.raises(ValueError):
        cli.main([store.root, "edit", "COMPONENT:battery", "status=approved"])


def test_merge_and_missing_key(spark, filled):
    _, store, _ = filled
    before = store.read("entity_candidates").count()
    cli.main([store.root, "merge", "COMPONENT:star_tracker", "COMPONENT:sun_sensor"])
    merged = by_key(store.read("entity_candidates"), "COMPONENT:star_tracker").first()
    assert store.read("entity_candidates").count() == before - 1 and any("sun sensor" in a.lower() for a in merged["aliases"])
    with pytest.raises(Exception, match="no candidate nothing"):
        U.merge_clusters(store.read("entity_candidates"), spark.createDataFrame([("nothing", "x")], "candidate_key string, survivor string")).collect()


def test_questions(spark, filled, capsys):
    _, store, _ = filled
    out = research.ask(spark, store, "What does the onboard computer control?", "simple")
    assert out["mode"] == "simple" and "onboard computer" in out["answer"]
    deep = research.ask(spark, store, "Give a comprehensive comparison of the battery and the star tracker", "auto")
    assert deep["mode"] == "deep" and deep["steps"]
    cli.main([store.root, "ask", "battery?", "--mode", "simple", "--top", "2"])
    assert "confidence" in capsys.readouterr().out
    assert store.log("queries", cli.HISTORY).count() == 3


def test_types_no_edge_has_reach_nothing(spark):
    ents = spark.createDataFrame([("1", "Alpha Box", ["c1"]), ("2", "Beta Box", ["c2"])], "id string, canonical_name string, chunk_ids array<string>")
    edges = spark.createDataFrame([("e", "1", "2", "CONTAINS")], "id string, source_entity_id string, target_entity_id string, type string")
    hits = spark.createDataFrame([("q1", "1", 0.95), ("q2", "1", 0.95), ("q3", "1", 0.95)], "query_id string, entity_id string, score double")
    q = spark.createDataFrame([("q1", "hierarchical", 3, ["CONTAINS"]), ("q2", "multi_hop", 3, ["AFFECTS"]), ("q3", "multi_hop", 3, [])], "query_id string, traversal string, max_depth int, relationship_types array<string>")
    got = {(r["query_id"], r["end"]) for r in research.walked(q, hits, edges, 3).collect()}
    assert got == {("q1", "2"), ("q3", "2")} and ents.count() == 2


def test_update_run(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name, text in (("a.md", ONE), ("b.md", TWO), ("c.md", ONE + "more")):
        (src / name).write_text(text)
    store = Store(spark, str(tmp_path / "store"))
    ingestion.ingest(spark, str(src), store)
    (src / "a.md").rename(src / "z.md")
    (src / "b.md").write_text(TWO + "The antenna is new.\n")
    (src / "c.md").unlink()
    (src / "d.md").write_text("# New\nThe thruster is described here with more than a hundred characters of text so that it is a chunk of its own.\n")
    want = {"unchanged": 0, "new": 1, "modified": 1, "renamed": 1, "deleted": 1}
    assert update_run.update(spark, str(src), store, dry_run=True) == want and store.read("documents").count() == 3
    assert update_run.update(spark, str(src), store) == want
    docs = {r["filename"] if not r["file_path"].endswith("z.md") else "z.md": r["document_id"] for r in store.read("documents").collect()}
    assert set(docs) == {"z.md", "b.md", "d.md"}
    assert {r["document_id"] for r in store.read("chunks").select("document_id").distinct().collect()} == set(docs.values())


def test_rule_files(spark, tmp_path):
    path = tmp_path / "rules.yaml"
    path.write_text("cleaning: {noise: ['^XX.*$', '[']}\nacronyms: {obc: [Onboard Computer], bad: []}\nrelation_phrases: [{type: feeds, phrase: ' feeds '}, {phrase: 3}]\ngazetteer: {tool: [Hammer]}\nother: 1\nsettings: {a: {b: 1, c: 2}}\n")
    r = rules.load(str(path), {"a": {"b": 5}})
    assert r.acronyms["OBC"] == "Onboard Computer" and r.relation_phrases == (("FEEDS", " feeds ", False),) and r.gazetteer["TOOL"] == ("hammer",) and r.settings == {"a": {"b": 5, "c": 2}}
    assert sorted(r.skipped) == ["acronyms.bad", "cleaning.noise", "other", "relation_phrases"]
    df = spark.createDataFrame([("keep\nXX gone\nend",)], "t string")
    assert df.select(X.cleaner(r.cleaning)("t")).first()[0].split() == ["keep", "end"]
    rules.dump_acronyms({"TC": ["Telemetry and Command"]}, str(tmp_path / "a.yaml"))
    assert rules.load(str(tmp_path / "a.yaml")).acronyms["TC"] == "Telemetry and Command"


def test_store_steps(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert set(store.create()) == set(schemas.SCHEMAS) and store.create() == [] and all(store.health().values())
    store.write("documents", store.read("documents").unionByName(spark.createDataFrame([("d", "completed")], "document_id string, ingestion_status string"), allowMissingColumns=True))
    store.write("chunks", store.read("chunks").unionByName(spark.createDataFrame([("c", "d")], "chunk_id string, document_id string"), allowMissingColumns=True))
    store.set_status("d", "ingesting")
    assert store.read("documents").first()["ingestion_status"] == "ingesting" and store.read("chunks").count() == 1
    store.set_status("d", "failed", "no reader")
    assert store.read("documents").first()["ingestion_error"] == "no reader" and store.read("chunks").count() == 0


def test_patterns_and_history(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"label": "A", "pattern": "x"}\nnot json\n{"label": "B"}\n')
    assert [tuple(r) for r in files.read_patterns(spark, str(tmp_path / "p.jsonl")).collect()] == [("A", "x")]
    (tmp_path / "h.jsonl").write_text('{"query_id": "1", "intent": "a", "timestamp": "2024-01-01T00:00:00"}\n{"query_id": "2", "intent": "b", "timestamp": "2024-01-02T00:00:00"}\n')
    assert [r["query_id"] for r in files.query_history(spark, str(tmp_path / "h.jsonl"), 1).collect()] == ["2"]


def test_vectors(spark):
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice(["A", "B", None, "UNKNOWN"]), [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)] + [(200, "A", [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, entity_type string, vec array<double>")

    def cos(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    goes = lambda a, b: (a or "UNKNOWN") == (b or "UNKNOWN") or "UNKNOWN" in (a or "UNKNOWN", b or "UNKNOWN")
    want = {(i, j) for i, s, v in rows for j, t, w in rows if i < j and goes(s, t) and cos(v, w) >= 0.6}
    assert {(r["left"], r["right"]) for r in V.similar_pairs(df, 0.6).collect()} == want
    old, V.BLOCK = V.BLOCK, 16
    try:
        assert {(r["left"], r["right"]) for r in V.similar_pairs(df, 0.6).collect()} == want
        asked = df.filter("id % 10 = 0").select(F.col("id").alias("query_id"), "vec")
        few, many = (sorted((r["query_id"], r["id"], r["rank"]) for r in V.knn(df, asked, k=5, least=None, broadcast_bytes=n).collect()) for n in (1 << 20, 0))
        assert few == many
    finally:
        V.BLOCK = old
    with pytest.raises(Exception, match="vector of another length"):
        K.upsert_vectors(None, df, 5).collect()


def test_index_recall(spark):
    sf = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = e.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")
    centres = V.fit_cells(e, cells=16)
    indexed = V.index_cells(e, centres)
    assert indexed.count() == e.count()
    exact = {(r["query_id"], r["id"]) for r in V.knn(e, asked, k=10, least=None).collect()}
    found = {(r["query_id"], r["id"]) for r in V.ann(indexed, centres, asked, k=10, probes=13).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_index_search_meets_blocks_and_ranks_by_exact_score_then_id(spark):
    import random

    rng = random.Random(6)
    vectors = [[float(rng.gauss(0, 1)) for _ in range(8)] for _ in range(150)] + [[0.5] * 8] * 60 + [[0.0] * 8] * 3
    rows = [((1 << 60) + i, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    asked = df.filter("id % 10 = 0").select(F.col("id").alias("query_id"), "vec")
    centres = V.fit_cells(df, cells=5)
    indexed = V.index_cells(df, centres)
    pairs = asked.withColumnsRenamed({"vec": "w"}).withColumn("cell", F.explode(V._nearest(centres, 3)(F.col("w")))).join(indexed, "cell")
    scored = pairs.select("query_id", "id", V.S.cosine(F.col("vec"), F.col("w")).alias("score")).toPandas()
    best = scored.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(7)
    want = set(best.itertuples(index=False, name=None))
    old = V.BLOCK
    try:
        for block in (old, 16):
            V.BLOCK = block
            got = V.ann(indexed, centres, asked, k=7, probes=3)
            assert {(r["query_id"], r["id"], r["score"]) for r in got.collect()} == want
            assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()  # no row for each pair of a cell
    finally:
        V.BLOCK = old
    text = lambda d, c: d.withColumn(c, F.col(c).cast("string"))
    words = V.ann(text(indexed, "id"), centres, text(asked, "query_id"), k=7, probes=3)
    assert {(int(r["query_id"]), int(r["id"]), r["score"]) for r in words.collect()} == want
    assert V.ann(indexed.filter("id < 0"), centres, asked, k=7, probes=3).count() == 0


def test_block_of_equal_vectors_is_ranked_in_bounded_memory():
    import tracemalloc

    import numpy as np

    v = np.full((1024, 64), 0.25)
    tracemalloc.start()
    points, asked, scores = V._best(v, v, np.arange(1024)[::-1], 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert points.tolist() == [1023, 1022, 1021] * 1024 and asked.tolist() == np.repeat(np.arange(1024), 3).tolist() and set(scores) == {1.0}
    assert peak < 300 << 20


def test_embedding_cache_and_backfill(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "three"), (3, "one two"), (4, None)], "id long, text string")
    first, cache = V.embed_cached(df, F.col("text"))
    assert first.count() == 4 and cache.count() == 3
    again, full = V.embed_cached(df.union(spark.createDataFrame([(5, "new")], "id long, text string")), F.col("text"), cache)
    assert again.count() == 5 and full.count() == 4
    assert V.cache_hits(df, F.col("text"), cache).first()["hit_rate"] == 1.0
    ents = spark.createDataFrame([("a", "Alpha", None, None, "approved"), ("b", "Beta", "d", ["x"], "approved"), ("c", "C", None, None, "pending")], "id string, canonical_name string, description string, aliases array<string>, status string")
    done = V.backfill(ents, None)
    assert {r["id"] for r in done.collect()} == {"a", "b"} and V.backfill(ents, done).count() == 2
    assert ents.orderBy("id").select(V.curated_text(F.col("canonical_name"), F.col("description"), F.col("aliases"))).collect()[1][0] == "Beta. d. x"


def test_merging_to_a_fixpoint(spark):
    rows = [(f"K:{i}", n, "SYSTEM", [], "", 0.5, "pending", 1, ["d"], [str(i)], []) for i, n in enumerate(["main bus", "main bus", "Main Bus", "side bus", "antenna"])]
    c = spark.createDataFrame(rows, "candidate_key string, canonical_name string, candidate_type string, aliases array<string>, description string, confidence_score double, status string, mention_count long, source_documents array<string>, chunk_ids array<string>, conflicting_types array<string>")
    out = discovery_run.deduplicate(c, 0.99)
    assert sorted((r["canonical_name"].lower(), r["mention_count"]) for r in out.collect()) == [("antenna", 1), ("main bus", 3), ("side bus", 1)]


def test_a_failed_stage_leaves_the_status_and_can_be_run_again(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text(ONE)
    store = Store(spark, str(tmp_path / "store"))
    whole = list(ingestion.STAGES)

    def broken(t):
        raise RuntimeError("stage is broken")

    ingestion.STAGES[1] = ("chunking", broken)
    try:
        with pytest.raises(RuntimeError, match="broken"):
            ingestion.ingest(spark, str(src), store)
    finally:
        ingestion.STAGES[:] = whole
    row = store.read("documents").first()
    assert (row["ingestion_status"], row["ingestion_error"]) == ("failed", "stage is broken") and not store.exists("chunks")
    assert ingestion.ingest(spark, str(src), store)["ingested"] == 1 and store.read("documents").first()["ingestion_status"] == "completed"
