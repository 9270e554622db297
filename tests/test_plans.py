import glob

from pyspark.sql import functions as F

from tessera import cli
from tessera.operators import candidates as K
from tessera.plans import discovery_run, ingestion, research
from tessera.sources.store import Store
from tessera.streaming import ingest as S

ONE = """# Power
The power supply unit feeds the bus. The motor controller monitors the battery.
## Modes
A solar array drive is a type of power source. Telemetry and Command (TC) is listed here with the battery and the sensor module for checks.
"""
TWO = """# Control
The onboard computer controls the reaction wheel. The onboard computer monitors the star tracker.
## Start
The startup procedure starts the onboard computer and the star tracker and then checks each sensor of the power supply unit.
"""


def store_with_docs(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "one.md").write_text(ONE)
    (src / "two.md").write_text(TWO)
    (src / "skip.bin").write_text("x")
    store = Store(spark, str(tmp_path / "store"))
    return src, store, ingestion.ingest(spark, str(src), store)


def test_ingest_discover_and_ask(spark, tmp_path):
    src, store, counts = store_with_docs(spark, tmp_path)
    assert counts == {"read": 2, "ingested": 2, "failed": 0}
    assert {r["title"] for r in store.read("documents").collect()} == {"Power", "Control"}
    cands = store.read("entity_candidates")
    assert {"COMPONENT:onboard_computer", "COMPONENT:star_tracker"} <= {r["candidate_key"] for r in cands.collect()}
    before = cands.count()
    assert ingestion.ingest(spark, str(src), store)["ingested"] == 0 and store.read("entity_candidates").count() == before
    (src / "two.md").write_text(TWO + "\nMore about the antenna.\n")
    assert ingestion.ingest(spark, str(src), store)["ingested"] == 1
    assert store.read("documents").filter("ingestion_status = 'completed'").count() == 2
    report = discovery_run.discover(store.read("entity_candidates"))
    discovery_run.write_report(report, str(tmp_path / "report"))
    assert len(glob.glob(str(tmp_path / "report/*"))) == 4 and report["statistics"].first()["candidates"] >= before
    ents = store.read("entity_candidates").select("id", "canonical_name", "chunk_ids")
    o = {r["canonical_name"].lower(): r["id"] for r in ents.collect()}
    edges = spark.createDataFrame([("e", o["onboard computer"], o["star tracker"], "MONITORS")], "id string, source_entity_id string, target_entity_id string, type string")
    asked = spark.createDataFrame([("q", "What does the onboard computer monitor?")], "query_id string, text string")
    hits = research.retrieve(asked, store.read("chunks"), store.read("chunk_vectors"), ents, edges).orderBy("rank").collect()
    assert hits and any("onboard computer" in r["content"] for r in hits[:3]) and {"hybrid", "graph", "vector"} & {r["source"] for r in hits}


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read("chunks").count() == 0 and not store.rollback("chunks")
    store.write("chunks", spark.range(3).select(F.col("id").cast("string").alias("chunk_id")))
    store.write("chunks", store.read("chunks").limit(1))
    assert store.read("chunks").count() == 1 and store.read("chunks", 0).count() == 3
    assert store.rollback("chunks") and store.read("chunks").count() == 3


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text(ONE)
    store = Store(spark, str(tmp_path / "store"))
    for name, text in (("a.md", ONE), ("b.md", TWO)):
        (src / name).write_text(text)
        S.ingest_stream(spark, str(src), store, str(tmp_path / "cp")).awaitTermination(120)
    assert {r["title"] for r in store.read("documents").collect()} == {"Power", "Control"}


def test_research_stops_when_nothing_is_new():
    rows = [{"chunk_id": "1", "content": "x", "final_score": 0.8}]
    out = research.research("q", lambda q, k: rows, lambda q, c: (False, "more"), lambda q, m: ["sub"], lambda q, c: "a long enough answer that has more than ten words in all of it")
    assert len(out["steps"]) == 1 and out["confidence"] == 0.8


def test_filter_words(spark):
    df = spark.createDataFrame([("k", "Bus", "SYSTEM", [], 0.9, 1, "pending"), ("l", "Motor", "COMPONENT", ["bus motor"], 0.4, 1, "approved")], "candidate_key string, canonical_name string, candidate_type string, aliases array<string>, confidence_score double, mention_count long, status string")
    assert [r[0] for r in cli.filtered(df, ["bus", "confidence>=0.5"]).collect()] == ["k"]
    assert [r[0] for r in K.page(cli.filtered(df, ["bus"]), 5).collect()] == ["k", "l"]
