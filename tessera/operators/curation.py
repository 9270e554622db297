"""Curation as sets: lookups of approved names, decisions, promotion of relations, undo by replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..functions import similarity as S
from . import candidates as K
from . import graph as G
from . import normalization as N


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def approved_lookup(entities: DataFrame) -> DataFrame:
    """(name, entity_type) -> entity_id over names and aliases; a canonical name beats any alias, else the first entity by id."""
    names = entities.select("id", "entity_type", schemas.approved_key(F.col("canonical_name")).alias("name"), F.lit(0).alias("way"))
    alias = entities.select("id", "entity_type", F.explode(_list("aliases")).alias("a")).select("id", "entity_type", schemas.approved_key(F.col("a")).alias("name"), F.lit(1).alias("way"))
    return names.unionByName(alias).filter("name <> ''").groupBy("name", "entity_type").agg(F.min_by("id", F.struct("way", "id")).alias("entity_id"))


def pre_resolve(candidates: DataFrame, lookup: DataFrame) -> DataFrame:
    """candidates with entity_id and reason ('canonical_name' or 'alias:…') where an approved entity is meant; null else."""
    probe = candidates.select("candidate_key", "candidate_type", F.posexplode(F.concat(F.array("canonical_name"), _list("aliases"))).alias("pos", "said"))
    hit = probe.withColumn("name", schemas.approved_key(F.col("said"))).join(lookup.withColumnRenamed("entity_type", "candidate_type"), ["name", "candidate_type"])
    best = hit.groupBy("candidate_key").agg(F.min_by(F.struct("entity_id", "pos", "said"), "pos").alias("b"))
    reason = F.when(F.col("b").isNotNull(), F.when(F.col("b.pos") == 0, F.lit("canonical_name")).otherwise(F.concat(F.lit("alias:"), F.col("b.said"))))
    return candidates.join(best, "candidate_key", "left").withColumn("entity_id", F.col("b.entity_id")).withColumn("reason", reason).drop("b")


def promote_relations(relations: DataFrame, normalization: DataFrame, normalized=schemas.key_fragment) -> DataFrame:
    """Edges of the relation candidates whose both ends are approved in the normalisation table; ids are deterministic."""
    ok = normalization.filter((F.col("status") == "approved") & F.col("canonical_id").isNotNull()).select("normalized_form", "canonical_id")
    r = relations.filter(F.col("type").isin(*C.RELATIONSHIP_TYPES)).withColumn("_s", normalized(F.col("source"))).withColumn("_t", normalized(F.col("target")))
    r = r.join(ok.withColumnsRenamed({"normalized_form": "_s", "canonical_id": "source_entity_id"}), "_s").join(ok.withColumnsRenamed({"normalized_form": "_t", "canonical_id": "target_entity_id"}), "_t")
    r = r.withColumn("id", schemas.relationship_id(F.col("source_entity_id"), F.col("type"), F.col("target_entity_id")))
    return r.groupBy("id", "type", "source_entity_id", "target_entity_id").agg(
        F.max("confidence_score").alias("confidence_score"), F.min("candidate_key").alias("candidate_key"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(_list("source_documents"))))).alias("source_documents")
    )


def expand_provenance(relations: DataFrame) -> DataFrame:
    """JSON provenance events as structs; one per source document where there is none."""
    event = "source string, document_id string, chunk_id string, confidence double"
    read = F.filter(F.transform(_list("provenance_events"), lambda e: F.from_json(e, event)), lambda s: s.isNotNull())
    null = lambda t: F.lit(None).cast(t)
    plain = F.transform(
        _list("source_documents"), lambda d: F.struct(null("string").alias("source"), d.alias("document_id"), null("string").alias("chunk_id"), null("double").alias("confidence"))
    )
    return relations.withColumn("provenance", F.when(F.size(read) > 0, read).otherwise(plain))


def peer_status(relations: DataFrame, keys: DataFrame, candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Pending relations of the focal keys, with the state of the other end.

    Key, name and alias matches are three equi-joins united, not one join with OR.
    """
    focal = keys.select("key").distinct()
    pend = relations.filter(F.col("status") == "pending")
    side = lambda a, b: pend.join(focal, F.col(a) == F.col("key")).select("candidate_key", "key", F.col(b).alias("peer"))
    rows = side("source", "target").unionByName(side("target", "source")).distinct()
    low = schemas.approved_key(F.col("peer"))

    def states(table: DataFrame, key: str, name: str, status: str) -> DataFrame:
        t = table.select(F.col(key).alias("_k"), schemas.approved_key(F.col(name)).alias("_n"), _list("aliases").alias("_a"), F.col("status").alias("_s"))
        by_key = rows.join(t, F.col("peer") == F.col("_k")).select("candidate_key", "key", "peer", "_s")
        by_name = rows.join(t, low == F.col("_n")).select("candidate_key", "key", "peer", "_s")
        alias = t.select("_s", F.explode("_a").alias("a")).select("_s", schemas.approved_key(F.col("a")).alias("_n"))
        by_alias = rows.join(alias, low == F.col("_n")).select("candidate_key", "key", "peer", "_s")
        return by_key.union(by_name).union(by_alias).groupBy("candidate_key", "key", "peer").agg(F.min("_s").alias(status))

    out = rows.join(states(candidates, "candidate_key", "canonical_name", "candidate_status"), ["candidate_key", "key", "peer"], "left").join(
        states(entities, "candidate_key", "canonical_name", "entity_status"), ["candidate_key", "key", "peer"], "left"
    )
    kind = F.when(F.col("entity_status") == "approved", "promotable").when(F.col("candidate_status") == "pending", "resolvable").otherwise("missing")
    return out.withColumn("issue", kind)


def by_threshold(candidates: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Preview of a batch approval: action is 'approve' or 'skip'."""
    return candidates.withColumn("action", F.when(F.col("confidence_score") >= threshold, "approve").otherwise("skip"))


def auto_approve_existing(candidates: DataFrame, lookup: DataFrame) -> DataFrame:
    """Candidates that are an approved entity under another key, without conflicting types."""
    return pre_resolve(candidates, lookup).filter(F.col("entity_id").isNotNull() & (F.size(_list("conflicting_types")) == 0))


EDITABLE = ("canonical_name", "candidate_type", "description", "confidence_score", "aliases")


def replay(candidates: DataFrame, log: DataFrame, upto: int | None = None) -> DataFrame:
    """State of the candidates after the decisions in the log (seq, candidate_key, action, patch columns).

    Approve, reject, edit and merge; `undo` takes back the latest decision before it that
    isn't taken back yet, within its session where the log has a column `session`. The
    state at any point is the fold of the log up to it, so rolling back is replaying less.
    """
    last = live_decisions(log if upto is None else log.filter(F.col("seq") <= upto)).groupBy("candidate_key").agg(
        F.max_by("action", F.when(F.col("action").isin("approve", "reject", "merge"), F.col("seq"))).alias("_action"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_p_{c}") for c in EDITABLE if c in log.columns],
    )
    j = candidates.join(last, "candidate_key", "left")
    status = F.when(F.col("_action") == "approve", "approved").when(F.col("_action") == "reject", "rejected").when(F.col("_action") == "merge", "merged_into_entity").otherwise(F.col("status"))
    cols = [status.alias(c) if c == "status" else F.coalesce(f"_p_{c}", c).alias(c) if c in EDITABLE and c in log.columns else F.col(c) for c in candidates.columns]
    return j.select(*cols)


def live_decisions(log: DataFrame) -> DataFrame:
    """The decisions of a log that no undo takes back.

    Read from the end, an undo cancels the next decision not cancelled by a later one, as
    brackets pair up. A curator's session is what one task sorts; a log without sessions
    is one.
    """
    w = (W.partitionBy("session") if "session" in log.columns else W.partitionBy(F.lit(0))).orderBy(F.desc("seq"))
    undo = F.when(F.col("action") == "undo", 1).otherwise(-1)
    rows = log.withColumn("_d", F.sum(undo).over(w))
    low = F.min("_d").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_low", F.least(F.coalesce(low, F.lit(0)), F.lit(0)))
    return rows.filter((F.col("action") != "undo") & (F.col("_d") < F.col("_low"))).drop("_d", "_low")


def session_statistics(log: DataFrame) -> DataFrame:
    """session, decisions by kind, minutes from the first to the last, decisions a minute (0 for a session of no length)."""
    n = lambda a: F.count_if(F.col("action") == a)
    at = F.col("at").cast("timestamp")
    minutes = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 60e6
    out = log.groupBy("session").agg(F.count(F.lit(1)).alias("decisions"), n("approve").alias("approved"), n("reject").alias("rejected"), n("undo").alias("undone"), minutes.alias("minutes"))
    return out.withColumn("velocity", F.when(F.col("minutes") > 0, F.col("decisions") / F.col("minutes")).otherwise(F.lit(0.0)))


def decide(tables: dict[str, DataFrame], decisions: DataFrame, normalized=F.lower) -> dict[str, DataFrame]:
    """Approvals and rejections with all that follows from them, as one set of new tables.

    tables: entity_candidates, entities, normalization, relationship_candidates,
    relationships. decisions: (candidate_key, action 'approve' or 'reject', reason). An
    approved candidate becomes an entity, its names become approved normalisation entries,
    and relation candidates whose both ends are now approved become edges. Only pending
    candidates are decided; the others are skipped. `audit` has one row a decision.
    """
    said = decisions.groupBy("candidate_key").agg(F.max_by(F.struct("action", "reason"), F.struct(F.col("action"), F.col("reason"))).alias("_d"))
    rows = tables["entity_candidates"].join(said, "candidate_key", "left")
    hit = (F.col("status") == "pending") & F.col("_d").isNotNull()
    status = F.when(hit & (F.col("_d.action") == "approve"), "approved").when(hit & (F.col("_d.action") == "reject"), "rejected").otherwise(F.col("status"))
    audit = rows.filter(F.col("_d").isNotNull()).select("candidate_key", F.col("_d.action").alias("action"), F.col("_d.reason").alias("reason"), hit.alias("applied"))
    candidates = rows.withColumn("_s", status).select(*[F.col("_s").alias("status") if c == "status" else F.col(c) for c in tables["entity_candidates"].columns])
    fresh = approve(candidates.join(audit.filter("applied and action = 'approve'").select("candidate_key"), "candidate_key", "left_semi"))
    entities = K.upsert_rows(tables["entities"], fresh, "id")
    now = F.current_timestamp()
    entries = normalization_entries(fresh, normalized).select(
        "*", F.lit("manual").alias("method"), F.lit(1.0).alias("confidence"), now.alias("created_at"), now.alias("updated_at"), F.lit("").alias("notes"), F.lit("curation").alias("source"), F.lit("approved").alias("status"), F.lit(1).alias("version")
    )
    normalization = N.upsert(tables["normalization"], entries)
    edges = promote_relations(tables["relationship_candidates"].filter("status <> 'rejected'"), normalization)
    have = tables["relationships"]
    edges = edges.select(*[F.lit("approved").alias(c) if c == "status" else F.col(c) if c in edges.columns else F.lit(None).cast(have.schema[c].dataType).alias(c) for c in have.columns])
    return {"entity_candidates": candidates, "entities": entities, "normalization": normalization, "relationships": K.upsert_rows(have, edges, "id"), "audit": audit}


def decide_relations(relations: DataFrame, decisions: DataFrame, normalization: DataFrame, normalized=schemas.key_fragment) -> tuple[DataFrame, DataFrame]:
    """(relations, edges) after approving or rejecting relation candidates.

    An approved candidate becomes an edge if both its ends are approved names; otherwise it
    stays pending, and `reason` says why.
    """
    said = decisions.groupBy("candidate_key").agg(F.max("action").alias("_a"))
    rows = relations.join(said, "candidate_key", "left")
    ok = normalization.filter((F.col("status") == "approved") & F.col("canonical_id").isNotNull()).select("normalized_form").distinct()
    for side, flag in (("source", "_s"), ("target", "_t")):
        known = ok.select(F.col("normalized_form").alias(f"_n{flag}"), F.lit(True).alias(flag))
        rows = rows.join(known, normalized(F.col(side)) == F.col(f"_n{flag}"), "left")
    whole = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    asked = (F.col("status") == "pending") & F.col("_a").isNotNull()
    status = F.when(asked & (F.col("_a") == "approve") & whole, "approved").when(asked & (F.col("_a") == "reject"), "rejected").otherwise(F.col("status"))
    reason = F.when(asked & (F.col("_a") == "approve") & ~whole, F.when(F.col("_s").isNull(), "source not approved").otherwise("target not approved"))
    out = rows.withColumn("_new", status).withColumn("reason", reason).select(*[F.col("_new").alias("status") if c == "status" else F.col(c) for c in relations.columns], "reason")
    newly = out.join(said.filter("_a = 'approve'").select("candidate_key"), "candidate_key", "left_semi").filter("status = 'approved'")
    return out, promote_relations(newly, normalization, normalized)


def survivors(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidate_key, survivor: of each component the candidate with most mentions, then the longest name, then the greatest key."""
    rows = members.select(F.col("node").alias("candidate_key"), "component").join(candidates, "candidate_key")
    best = rows.groupBy("component").agg(F.max_by("candidate_key", F.struct("mention_count", F.char_length("canonical_name"), "candidate_key")).alias("survivor"))
    return rows.select("candidate_key", "component").join(best, "component").select("candidate_key", "survivor")


def merge_clusters(candidates: DataFrame, clusters: DataFrame) -> DataFrame:
    """candidates with each cluster (candidate_key, survivor) folded into its survivor: all clusters or none.

    A key that isn't there raises when the result is read. Candidates of no cluster stay.
    """
    c = clusters.join(candidates.select("candidate_key", F.lit(True).alias("_there")), "candidate_key", "left")
    told = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no candidate "), F.col("candidate_key")))).otherwise(F.col("survivor"))
    of = c.select("candidate_key", told.alias("survivor"))
    rows = candidates.join(of, "candidate_key", "left").withColumn("survivor", F.coalesce("survivor", "candidate_key"))
    folded = K.fold_survivors(rows).withColumnRenamed("survivor", "candidate_key")
    keep = [x for x in candidates.columns if x not in folded.columns]
    return folded.join(candidates.select("candidate_key", *keep), "candidate_key").select(*[x for x in candidates.columns if x in folded.columns or x in keep])


def auto_merge(candidates: DataFrame, suggest, rounds: int = 10) -> DataFrame:
    """candidates merged until `suggest` (candidates -> left, right of what is to be merged by itself) has nothing more.

    Each round links the suggestions into components, picks survivors and folds; its
    result is written. Raises if it hasn't settled after `rounds`.
    """
    for _ in range(rounds):
        pairs = G.written(suggest(candidates).select("left", "right"), "auto")
        if pairs.isEmpty():
            return candidates
        candidates = G.written(merge_clusters(candidates, survivors(G.connected_components(pairs), candidates)), "merged")
    if not suggest(candidates).isEmpty():
        raise RuntimeError("automatic merging did not settle")
    return candidates


def compare_pairs(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Both candidates of each pair (left, right) side by side, what they share, and what merging them would give."""
    one = lambda p: candidates.select(F.col("candidate_key").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("canonical_name", "candidate_type", "mention_count", "confidence_score", "aliases", "source_documents")])
    j = pairs.select("left", "right").join(one("left"), "left").join(one("right"), "right")
    names = lambda p: F.transform(F.concat(F.array(f"{p}_canonical_name"), _list(f"{p}_aliases")), schemas.approved_key)
    left_wins = F.struct("left_mention_count", F.char_length("left_canonical_name"), "left") >= F.struct("right_mention_count", F.char_length("right_canonical_name"), "right")
    return j.select(
        "left", "right", "left_canonical_name", "right_canonical_name", (F.col("left_candidate_type") == F.col("right_candidate_type")).alias("same_type"),
        F.array_sort(F.array_intersect(names("left"), names("right"))).alias("shared_names"), F.size(F.array_intersect(_list("left_source_documents"), _list("right_source_documents"))).alias("shared_documents"),
        F.when(left_wins, F.col("left")).otherwise(F.col("right")).alias("survivor"), (F.col("left_mention_count") + F.col("right_mention_count")).alias("mention_count"), F.greatest("left_confidence_score", "right_confidence_score").alias("confidence_score"),
        F.size(F.array_union(_list("left_source_documents"), _list("right_source_documents"))).alias("documents"),
    )


def approve(candidates: DataFrame) -> DataFrame:
    """Entities of approved candidates; ids follow from the keys, so approving twice changes nothing."""
    return candidates.filter(F.col("status") == "approved").select(
        schemas.uuid5(F.concat(F.lit("entity:"), F.col("candidate_key"))).alias("id"), "canonical_name", F.col("candidate_type").alias("entity_type"), "aliases", "description",
        "confidence_score", "status", "mention_count", "source_documents", "chunk_ids", "candidate_key", F.array("candidate_key").alias("merged_candidate_keys"),
    )


def merge_into_entity(entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates (with entity_id) folded into their entities: mentions added, the highest confidence, lists and aliases united.

    Entities without a candidate stay; candidates of no entity that is there are left out.
    """
    folded = candidates.groupBy("entity_id").agg(
        F.sum("mention_count").alias("m"), F.max("confidence_score").alias("c"), F.flatten(F.collect_list(F.concat(F.array("canonical_name"), _list("aliases")))).alias("al"),
        F.flatten(F.collect_list(_list("source_documents"))).alias("d"), F.flatten(F.collect_list(_list("chunk_ids"))).alias("ch"), F.min_by("description", "candidate_key").alias("de"), F.collect_set("candidate_key").alias("ks"),
    )
    j = entities.join(folded, entities["id"] == folded["entity_id"], "left")
    union = lambda base, more: F.array_sort(F.array_union(_list(base), F.coalesce(more, F.array().cast("array<string>"))))
    new = {
        "mention_count": F.col("mention_count") + F.coalesce("m", F.lit(0)), "confidence_score": F.greatest("confidence_score", F.coalesce("c", F.lit(0.0))), "aliases": F.array_except(union("aliases", "al"), F.array("canonical_name")),
        "source_documents": union("source_documents", "d"), "chunk_ids": union("chunk_ids", "ch"), "description": F.coalesce(F.nullif("description", F.lit("")), "de"), "merged_candidate_keys": union("merged_candidate_keys", "ks"),
    }
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in entities.columns])


def normalization_entries(entities: DataFrame, normalized=F.lower) -> DataFrame:
    """Entries for every name of an approved entity."""
    said = entities.select("id", "canonical_name", "entity_type", F.explode(F.concat(F.array("canonical_name"), _list("aliases"))).alias("raw"))
    return said.groupBy(normalized(F.trim("raw")).alias("normalized_form"), F.col("id").alias("canonical_id"), "canonical_name", "entity_type").agg(F.array_sort(F.collect_set("raw")).alias("raw_variants"))


def duplicates(candidates: DataFrame, top: int = 5, least: float = 0.7, similar: DataFrame | None = None) -> DataFrame:
    """Likely duplicates of each candidate among all others, of any type: a shared alias 1, alike names, a name in an alias .9.

    similar (left, right, similarity) adds pairs whose embeddings are alike, where a caller has them.
    """
    c = candidates.select("candidate_key", schemas.approved_key(F.col("canonical_name")).alias("n"), F.transform(_list("aliases"), lambda a: F.lower(F.trim(a))).alias("al"))
    alias = c.select("candidate_key", F.explode("al").alias("a"))
    pair = lambda a, b, on: a.join(b, on).filter("left <> right")
    shared = pair(alias.withColumnRenamed("candidate_key", "left"), alias.withColumnRenamed("candidate_key", "right"), ["a"]).select("left", "right", F.lit(1.0).alias("score"))
    named = c.select("candidate_key", F.col("n").alias("a"))
    inside = pair(named.withColumnRenamed("candidate_key", "left"), alias.withColumnRenamed("candidate_key", "right"), ["a"]).select("left", "right", F.lit(0.9).alias("score"))
    inside = inside.union(inside.select("right", "left", "score"))
    # Keys of one name score alike, so only its first `top` besides the candidate itself can be among the best.
    first = named.withColumn("_n", F.row_number().over(W.partitionBy("a").orderBy("candidate_key"))).filter(F.col("_n") <= top + 1)
    close = similar_names(named.select(F.col("a").alias("n")), least)
    close = close.join(named.select(F.col("candidate_key").alias("left"), F.col("a").alias("ln")), "ln").join(first.select(F.col("candidate_key").alias("right"), F.col("a").alias("rn")), "rn")
    close = close.filter("left <> right").select("left", "right", "score")
    if similar is not None:
        close = close.union(similar.select("left", "right", "similarity")).union(similar.select("right", "left", "similarity"))
    best = shared.union(inside).union(close).groupBy("left", "right").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("left").orderBy(F.desc("score"), "right"))).filter(F.col("rank") <= top)


#: Names of these lengths together may be alike (over 0.7) without two equal letters in a row; longer ones may not.
SHORT = 17


def similar_names(names: DataFrame, least: float = 0.7) -> DataFrame:
    """ln, rn, score of every ordered pair of distinct names with a sequence ratio over `least`, of 0.7 or more.

    Nothing is lost before the ratio. Of lengths a and b, M letters match in k blocks with
    k - 1 <= a + b - 2M gaps, and M > 0.7 (a + b) / 2: so 0.35 (a + b) < min(a, b), and for
    a + b over SHORT some block has two letters. Pairs up to SHORT meet by single letters.
    """
    if least < 0.7:
        raise ValueError("names are filtered for a ratio of 0.7 or more")
    n = names.filter("n is not null").distinct().withColumn("z", F.char_length("n"))
    at = F.sequence(F.lit(1), F.col("z"))
    grams = F.when(F.col("z") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.col("z") - 1, F.lit(1))), lambda i: F.substr("n", i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    letters = F.when((F.col("z") > 0) & (F.col("z") < SHORT), F.transform(at, lambda i: F.substr("n", i, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    units = n.select("n", "z", F.explode(F.array_distinct(F.concat(grams, letters))).alias("u"))
    a, b = (units.select(F.col("n").alias(f"{x}n"), F.col("z").alias(f"{x}z"), "u") for x in "lr")
    total = F.col("lz") + F.col("rz")
    met = a.join(b, "u").filter((20 * F.least("lz", "rz") > 7 * total) & ((F.char_length("u") == 2) | (total <= SHORT)))
    met = met.select("ln", "rn").distinct().union(n.filter("z = 0").select(F.col("n").alias("ln"), F.col("n").alias("rn")))
    return met.withColumn("score", S.sequence_ratio("ln", "rn")).filter(F.col("score") > least)


def filter_rows(candidates: DataFrame, least: float | None = None, kind: str | None = None, text: str | None = None) -> DataFrame:
    """Interactive filter: confidence, type, and a substring of name or alias."""
    rows = K.scan(candidates, None, [kind] if kind else None, least)
    if text:
        low = text.lower()
        rows = rows.filter(F.lower("canonical_name").contains(low) | F.exists(_list("aliases"), lambda a: F.contains(F.lower(a), F.lit(low))))
    return rows
