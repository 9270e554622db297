"""From files to candidates: one plan over all documents, written once at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..functions import text as X
from ..operators import candidates as K
from ..operators import chunking as H
from ..operators import extraction as E
from ..operators import graph as G
from ..operators import update as U
from ..operators import vectors as V
from ..rules import Rules
from ..sources import files, pdf
from ..sources.store import Store

Stage = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


def run_stages(tables: dict[str, DataFrame], stages: list[tuple[str, Stage]], skip: set[str] = frozenset()) -> dict[str, DataFrame]:
    """Sequential stages; each adds to or replaces the tables it is given.

    What a stage makes is written to the shared folder: later plans start from files, and a
    lost executor costs no more than its own stage.
    """
    for name, stage in stages:
        if name not in skip:
            tables = tables | {k: G.written(df, k) for k, df in stage(tables).items()}
    return tables


def cleaning(t: dict, rules: Rules | None = None) -> dict:
    clean = X.clean if rules is None else X.cleaner(rules.cleaning, rules.preserved)
    return {"documents": t["documents"].withColumn("raw_text", clean("raw_text"))}


def rewriting(rewrite: Callable) -> Stage:
    """A stage that rewrites chunks with a column function of the caller's, where numbers, acronyms and length are kept.

    `lost` tells what a refused rewrite would have lost; such a chunk stays as it was.
    """

    def stage(t: dict) -> dict:
        c = t["chunks"].withColumn("_new", rewrite(F.col("content"))).withColumn("lost", X.preserved(F.col("content"), F.col("_new")))
        return {"chunks": c.withColumn("content", F.when(F.col("lost").isNull() & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("content"))).drop("_new")}

    return stage


def chunking(t: dict) -> dict:
    return {"chunks": H.chunk_documents(t["documents"])}


def extraction(t: dict, rules: Rules | None = None) -> dict:
    """Mentions and relations; acronyms are looked up in one dictionary over all documents. Mentions go down to child chunks."""
    rules = rules or Rules()
    chunks = H.extraction_chunks(t["chunks"])
    relations = E.pattern_relations(chunks, rules.relation_phrases).unionByName(E.verb_relations(chunks))
    mentions = E.gazetteer_mentions(chunks, rules.gazetteer)
    found = E.endpoint_mentions(relations, mentions).select("*", F.lit("CONCEPT").alias("type"), F.array().cast("array<string>").alias("aliases"))
    mentions = mentions.unionByName(found, allowMissingColumns=True)
    definitions = E.acronym_definitions(chunks)
    resolved = definitions.select("chunk_id", "acronym", "expansion").distinct()
    merged = K.merge_mentions(E.expand_aliases(mentions, resolved), X.normalize_name("name"), C.ENTITY_TYPES)
    judged = E.validate_relations(relations, mentions)
    below = E.propagate_to_children(merged.select("chunk_id", F.col("canonical_name").alias("name"), "type", "aliases", "confidence"), t["chunks"])
    return {"mentions": merged, "child_mentions": below, "relations": judged.filter("reason is null").drop("reason"), "rejected": judged.filter("reason is not null"), "acronyms": E.acronym_dictionary(definitions)}


def candidates(t: dict) -> dict:
    """Per candidate key one row: counted once a document."""
    key = schemas.candidate_key(F.col("type"), F.col("normalized_name"), F.col("canonical_name"))
    event = F.to_json(F.struct(F.col("chunk_id"), F.col("confidence"), F.col("document_id")))
    now = F.lit("1970-01-01").cast("timestamp")
    ents = t["mentions"].select(
        schemas.candidate_id(key).alias("id"), key.alias("candidate_key"), "canonical_name", F.col("type").alias("candidate_type"), "aliases", "description", F.col("confidence").alias("confidence_score"),
        F.lit("pending").alias("status"), "mention_count", F.array("document_id").alias("source_documents"), F.array("chunk_id").alias("chunk_ids"), "conflicting_types", F.array(event).alias("provenance_events"), now.alias("first_seen"), now.alias("last_seen"),
    )
    rkey = schemas.relationship_key(F.lower("source"), F.col("type"), F.lower("target"))
    rels = t["relations"].select(
        schemas.candidate_id(rkey, "relationship").alias("id"), rkey.alias("candidate_key"), "source", "target", "type", F.lit(None).cast("string").alias("description"), F.col("confidence").alias("confidence_score"), F.lit("pending").alias("status"),
        F.lit(1).cast("long").alias("mention_count"), F.array("document_id").alias("source_documents"), F.array("chunk_id").alias("chunk_ids"), F.array(event).alias("provenance_events"), now.alias("first_seen"), now.alias("last_seen"),
    )
    return {"entity_candidates": ents, "relationship_candidates": rels}


def embedding(t: dict) -> dict:
    return {"chunk_vectors": t["chunks"].select("chunk_id", "document_id", "level", V.hashed_embedding(F.col("content")).alias("vec"))}


STAGES: list[tuple[str, Stage]] = [("cleaning", cleaning), ("chunking", chunking), ("extraction", extraction), ("candidates", candidates), ("embedding", embedding)]


def ingest(spark: SparkSession, path: str, store: Store, force: bool = False, topics: list[str] | None = None, skip: set[str] = frozenset(), rules: Rules | None = None) -> dict[str, int]:
    """Read what is new or changed below path, and fold it into the store's tables; running it again changes nothing.

    Returns how many documents were read, ingested and failed; the audit log has the rows of each stage as well.
    """
    return fold(store, files.read_documents(files.scan_files(spark, path), pdf.text), force, topics, skip, rules)


def fold(store: Store, docs: DataFrame, force: bool = False, topics: list[str] | None = None, skip: set[str] = frozenset(), rules: Rules | None = None) -> dict[str, int]:
    """Documents as read_documents gives them into all tables of the store."""
    stages = STAGES if rules is None else [(n, (lambda t, f=f: f(t, rules)) if n in ("cleaning", "extraction") else f) for n, f in STAGES]
    catalog = store.read("documents").withColumnRenamed("document_id", "id")
    docs = G.written(docs, "read")
    new = G.written(U.to_ingest(docs.filter("error is null"), catalog, force), "new")
    stale = U.outdated(new, catalog).select(F.col("id").alias("document_id"))
    redone = new.select("document_id").union(stale).distinct()
    cols = [c.split()[0] for c in schemas.SCHEMAS["documents"].split(", ")]
    known = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(schemas.struct("documents")[c].dataType).alias(c) for c in cols])
    try:
        t = run_stages({"documents": new}, stages, skip)
    except Exception as problem:  # no table has been written yet, so there is nothing to take back
        lost = known(new.withColumns({"ingestion_status": F.lit("failed"), "ingestion_error": F.lit(str(problem)[:1000])}))
        store.write("documents", K.upsert_rows(store.read("documents").select(*cols), lost, "document_id"))
        raise
    now = F.current_timestamp()
    rows = new.withColumns({"ingestion_status": F.lit("completed"), "last_ingested_at": now})
    failed = docs.filter("error is not null").withColumns({"ingestion_status": F.lit("failed"), "ingestion_error": F.col("error")})
    counts = {"read": docs.count(), "ingested": new.count(), "failed": failed.count()}
    base = K.delete_keys(store.read("documents"), stale, "document_id").select(*cols)
    store.write("documents", K.upsert_rows(base, known(rows).unionByName(known(failed)), "document_id"))
    for name in ("chunks", "chunk_vectors"):
        if name in t:
            old = K.delete_keys(store.read(name), redone, "document_id") if store.exists(name) else None
            store.write(name, t[name] if old is None else old.unionByName(t[name], allowMissingColumns=True))
    for name in ("entity_candidates", "relationship_candidates"):
        if name in t:
            store.write(name, K.upsert_candidates(store.read(name) if store.exists(name) else None, t[name]))
    if topics:
        linked = new.select("document_id", F.array(*map(F.lit, topics)).alias("topics"))
        old = store.read("document_topics") if store.exists("document_topics") else None
        store.write("document_topics", K.links(old, linked, "document_id", "topics", "topic"))
    store.record("ingest", counts | {k: t[k].count() for k in ("chunks", "mentions", "relations", "rejected") if k in t})
    return counts
