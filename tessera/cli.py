"""Command line over a store: python -m tessera.cli STORE VERB …"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import rules, schemas
from .operators import candidates as K
from .operators import curation as U
from .operators import graph as G
from .operators import normalization as N
from .operators import vectors as V
from .plans import discovery_run, ingestion, research, update_run
from .sources import files
from .sources.store import Store, by_key


STATES, SORTS = ("pending", "approved", "rejected", "merged_into_entity"), ("confidence", "mentions", "name")


def parse_filter(words: list[str]) -> dict:
    """`key=value` and `confidence>=x` words of an interactive filter; unknown keys and values raise."""
    out: dict = {"text": []}
    for w in words:
        for op in (">=", "<=", "==", ">", "<", "="):
            if op in w:
                key, value = w.split(op, 1)
                if key not in ("type", "status", "confidence", "sort"):
                    raise ValueError(f"unknown filter {key}")
                out[key] = (op, float(value)) if key == "confidence" else value
                known = {"status": STATES, "sort": SORTS}.get(key)
                if known and value not in known:
                    raise ValueError(f"{key} is one of {', '.join(known)}")
                if key == "confidence" and not 0 <= out[key][1] <= 1:
                    raise ValueError("confidence lies between 0 and 1")
                break
        else:
            out["text"].append(w)
    return out


def filtered(rows, words: list[str]):
    f = parse_filter(words)
    rows = U.filter_rows(rows, kind=f.get("type"), text=" ".join(f["text"]) or None)
    if "status" in f:
        rows = rows.filter(F.col("status") == f["status"])
    if "confidence" in f:
        op, v = f["confidence"]
        c = F.col("confidence_score")
        rows = rows.filter({">=": c >= v, "<=": c <= v, ">": c > v, "<": c < v, "==": c == v, "=": c >= v}[op])
    return rows


def listed(rows, words: list[str], limit: int = 50):
    """A page of the review queue: the filters of the words, and their sort=confidence|mentions|name."""
    return K.sorted_queue(filtered(rows, words), parse_filter(words).get("sort", "confidence"), limit)


def decisions(spark, keys: list[str], action: str, reason: str = ""):
    return spark.createDataFrame([(k, action, reason) for k in keys], "candidate_key string, action string, reason string")


def decide(store: Store, said) -> None:
    """Writes all tables that follow from decisions; the audit goes to the log."""
    out = U.decide({t: store.read(t) for t in ("entity_candidates", "entities", "normalization", "relationship_candidates", "relationships")}, said, lambda c: schemas.key_fragment(c))
    audit = G.written(out.pop("audit"), "audit")
    for name, df in out.items():
        store.write(name, df)
    store.append_log("audit", audit.select(F.current_timestamp().alias("at"), F.concat(F.col("action"), F.lit("_candidate")).alias("event"), F.to_json(F.struct("candidate_key", "reason", "applied")).alias("payload")))


def relationship(store: Store, verb: str, key: str) -> str:
    """Approves or rejects a relation candidate; tells why one that can't be approved stays pending."""
    said = store.spark.createDataFrame([(key, verb)], "candidate_key string, action string")
    rows, edges = U.decide_relations(store.read("relationship_candidates"), said, store.read("normalization"))
    rows = G.written(rows, "relations")
    have = store.read("relationships")
    edges = edges.select(*[F.lit("approved").alias(c) if c == "status" else F.col(c) if c in edges.columns else F.lit(None).cast(have.schema[c].dataType).alias(c) for c in have.columns])
    edges = G.written(edges, "edges")
    store.write("relationships", K.upsert_rows(have, edges, "id"))
    store.write("relationship_candidates", rows.drop("reason"))
    told = rows.filter(F.col("candidate_key") == key).select("status", "reason").first()
    return "no such candidate" if told is None else told["reason"] or told["status"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("store")
    verbs = p.add_subparsers(dest="verb", required=True)
    ingest = verbs.add_parser("ingest")
    ingest.add_argument("path")
    ingest.add_argument("--rules")
    ingest.add_argument("--force", action="store_true")
    verbs.add_parser("discover").add_argument("folder")
    update = verbs.add_parser("update")
    update.add_argument("path")
    update.add_argument("--dry-run", action="store_true")
    for name in ("queue", "search"):
        verbs.add_parser(name).add_argument("words", nargs="*")
    for name in ("stats", "undo", "auto-approve-existing", "history", "health", "backfill-embeddings"):
        verbs.add_parser(name)
    for name in ("show", "approve", "reject"):
        one = verbs.add_parser(name)
        one.add_argument("key")
        one.add_argument("--reason", default="")
    edit = verbs.add_parser("edit")
    edit.add_argument("key")
    edit.add_argument("changes", nargs="+", help="column=value; an empty value clears the column")
    merge = verbs.add_parser("merge")
    merge.add_argument("survivor")
    merge.add_argument("keys", nargs="+")
    for name in ("batch-approve", "batch-merge"):
        one = verbs.add_parser(name)
        one.add_argument("threshold", type=float)
        one.add_argument("--dry-run", action="store_true")
    norm = verbs.add_parser("normalization")
    norm.add_argument("what", choices=("queue", "search", "show", "stats", "export", "import"))
    norm.add_argument("term", nargs="?", default="")
    rel = verbs.add_parser("relationship")
    rel.add_argument("what", choices=("queue", "approve", "reject"))
    rel.add_argument("key", nargs="?", default="")
    asks = verbs.add_parser("ask")
    asks.add_argument("question")
    asks.add_argument("--mode", choices=("auto", "deep", "simple"), default="auto")
    asks.add_argument("--top", type=int, default=5)
    return p


SHOWN = ("candidate_key", "canonical_name", "candidate_type", "confidence_score", "mention_count", "status")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, a.store)
    rows = store.read("entity_candidates")
    pending = rows.filter("status = 'pending'")
    if a.verb == "ingest":
        print(ingestion.ingest(spark, a.path, store, a.force, rules=rules.load(a.rules) if a.rules else None))
    elif a.verb == "discover":
        report = discovery_run.discover(rows)
        discovery_run.write_report(report, a.folder)
        discovery_run.write_matrix(report, a.folder)
    elif a.verb == "update":
        print(update_run.update(spark, a.path, store, a.dry_run))
    elif a.verb in ("queue", "search"):
        listed(rows, a.words).select(*SHOWN).show(50, False)
    elif a.verb == "show":
        by_key(rows, a.key).show(1, False, True)
    elif a.verb == "stats":
        K.status_counts(rows).show()
        K.type_counts(rows, "candidate_type").show()
    elif a.verb == "health":
        print(store.health())
    elif a.verb == "history":
        files.history_statistics(store.log("queries", HISTORY)).show(50, False)
    elif a.verb in ("approve", "reject"):
        decide(store, decisions(spark, [a.key], a.verb, a.reason))
    elif a.verb == "edit":
        said = dict(c.split("=", 1) for c in a.changes)
        unknown = set(said) - {"canonical_name", "candidate_type", "description"}
        if unknown:
            raise ValueError(f"can't edit {sorted(unknown)}")
        cols = [F.lit(a.key).alias("candidate_key"), *[F.lit(v or None).cast("string").alias(k) for k, v in said.items()], F.array(*[F.lit(k) for k, v in said.items() if not v]).cast("array<string>").alias("cleared")]
        store.write("entity_candidates", K.patch(rows, spark.range(1).select(*cols), "candidate_key", tuple(said)))
    elif a.verb == "merge":
        store.write("entity_candidates", U.merge_clusters(rows, spark.createDataFrame([(k, a.survivor) for k in {a.survivor, *a.keys}], "candidate_key string, survivor string")))
    elif a.verb == "batch-approve":
        hit = pending.filter(F.col("confidence_score") >= a.threshold)
        if a.dry_run:
            print(hit.count(), "candidates would be approved")
        else:
            decide(store, hit.select("candidate_key", F.lit("approve").alias("action"), F.lit("batch").alias("reason")))
    elif a.verb == "batch-merge":
        found = discovery_run.merges(pending, a.threshold)
        if a.dry_run:
            print(found.count(), "candidates would be merged")
        else:
            store.write("entity_candidates", U.merge_clusters(rows, G.written(found, "merges")))
    elif a.verb == "auto-approve-existing":
        known = U.approved_lookup(store.read("entities"))
        hit = U.auto_approve_existing(pending, known).select("candidate_key", F.lit("approve").alias("action"), F.lit("known entity").alias("reason"))
        decide(store, hit)
    elif a.verb == "backfill-embeddings":
        have = store.read("entity_vectors") if store.exists("entity_vectors") else None
        store.write("entity_vectors", V.backfill(store.read("entities"), have))
    elif a.verb == "undo":
        done = [t for t in ("entity_candidates", "entities", "normalization", "relationships") if store.rollback(t)]
        print("undone" if done else "nothing to undo")
    elif a.verb == "normalization":
        t = store.read("normalization")
        if a.what == "export":
            N.export_csv(t, a.term)
        elif a.what == "import":
            store.write("normalization", N.upsert(t, N.import_csv(spark, a.term)))
        else:
            {"queue": lambda: N.queue(t), "search": lambda: N.search(t, a.term), "show": lambda: t.filter(F.col("normalized_form") == a.term.strip().lower()), "stats": lambda: N.statistics(t)}[a.what]().show(50, False)
    elif a.verb == "relationship":
        if a.what == "queue":
            store.read("relationship_candidates").filter("status = 'pending'").orderBy(F.desc("confidence_score"), "candidate_key").show(50, False)
        else:
            print(relationship(store, a.what, a.key))
    elif a.verb == "ask":
        out = research.ask(spark, store, a.question, a.mode, a.top)
        print(f"({out['mode']}, confidence {out['confidence']:.2f})\n{out['answer']}")


HISTORY = "query_id string, original_text string, intent string, intent_confidence double, entity_mentions array<string>, keywords array<string>, requires_graph_traversal boolean, timestamp timestamp"


if __name__ == "__main__":
    main()
