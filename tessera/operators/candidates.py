"""Candidate tables: aggregating upserts, merges, votes and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C

UNION_LISTS = ("source_documents", "chunk_ids", "provenance_events")


def no_strings() -> Column:
    return F.array().cast("array<string>")


def merged_lists(rows: DataFrame, key: str, names: list[str], order: str = "_seq") -> DataFrame:
    """key and, for each list column, the distinct elements of all rows' arrays in order of first appearance.

    Elements are deduplicated, with a map-side part, before a key's are gathered.
    """
    def numbered(k: int, name: str) -> Column:
        return F.transform(F.coalesce(name, no_strings()), lambda v, i: F.struct(F.lit(k).alias("k"), v.alias("v"), i.alias("i")))

    def of(k: int) -> Column:
        return F.transform(F.filter("all", lambda s: s["k"] == k), lambda s: s["v"])

    flat = rows.select(key, order, F.explode(F.concat(*[numbered(k, n) for k, n in enumerate(names)])).alias("e")).select(key, "e.k", "e.v", F.struct(F.col(order), F.col("e.i")).alias("o"))
    one = flat.groupBy(key, "k", "v").agg(F.min("o").alias("o")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "o", "v"))).alias("all"))
    return one.select(F.col(key).alias("_key"), *[of(k).alias(n) for k, n in enumerate(names)])


def upsert_candidates(existing: DataFrame | None, new: DataFrame, key: str = "candidate_key") -> DataFrame:
    """First writer keeps names, types, aliases and description; counts add up, confidence is the highest, lists are united.

    Aggregations with a map-side part; both sides may hold a key many times.
    """
    rows = new.withColumn("_seq", F.lit(1))
    if existing is not None:
        rows = existing.withColumn("_seq", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    rows = rows.withColumn("_seq", F.struct("_seq", F.coalesce("first_seen", F.lit(0).cast("timestamp")), F.xxhash64(*sorted(new.columns))))
    special = {"mention_count": F.sum("mention_count"), "confidence_score": F.max("confidence_score"), "first_seen": F.min("first_seen"), "last_seen": F.max("last_seen")}
    cols = [c for c in rows.columns if c != "_seq"]
    lists = [c for c in cols if c in UNION_LISTS]
    sums = [c for c in cols if c in special]
    firsts = [c for c in cols if c not in (key, *lists, *sums)]
    aggs = [special[c].alias(c) for c in sums] + ([F.min_by(F.struct(*firsts), "_seq").alias("_first")] if firsts else [])
    out = rows.groupBy(key).agg(*aggs) if aggs else rows.select(key).distinct()
    if lists:
        out = out.join(merged_lists(rows, key, lists), F.col(key).eqNullSafe(F.col("_key")), "left")
    return out.select(*[F.coalesce(c, no_strings()).alias(c) if c in lists else F.col("_first")[c].alias(c) if c in firsts else F.col(c) for c in cols])


def upsert_rows(existing: DataFrame | None, new: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """Last writer wins by key; new rows beat old ones, among new ones the highest seq."""
    rows = new.withColumn("_w", F.struct(F.lit(1), F.col(seq) if seq else F.xxhash64(*sorted(new.columns))))
    if existing is not None:
        old = existing.withColumn("_w", F.struct(F.lit(0), F.col(seq) if seq else F.xxhash64(*sorted(existing.columns))))
        rows = old.unionByName(rows, allowMissingColumns=True)
    cols = [c for c in rows.columns if c not in (key, "_w")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "_w").alias("r")).select(key, *[F.col("r")[c].alias(c) for c in cols])


def append_strict(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The union; a key that is there twice raises when it is read."""
    rows = existing.unionByName(new, allowMissingColumns=True)
    twice = F.count(F.lit(1)).over(W.partitionBy(key)) > 1
    guard = F.when(twice, F.raise_error(F.concat(F.lit("duplicate key "), F.col(key).cast("string")))).otherwise(F.col(key))
    return rows.withColumn(key, guard)


def upsert_edges(existing: DataFrame | None, new: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, rejected): an edge needs both its ends among the entities."""
    ids = entities.select(F.col("id").alias("_e")).distinct()
    whole = new.join(ids, new["source_entity_id"] == ids["_e"], "left_semi").join(ids, F.col("target_entity_id") == ids["_e"], "left_semi")
    bad = new.join(whole.select("id"), "id", "left_anti")
    return upsert_rows(existing, whole, "id"), bad


def patch(base: DataFrame, changes: DataFrame, key: str, editable: tuple[str, ...], clear: str = "cleared") -> DataFrame:
    """Columns of `editable` that a change sets replace those of the row with its key; null sets nothing.

    A change's array column `clear`, where there is one, names the columns to set to null.
    """
    cols = [c for c in editable if c in changes.columns or clear in changes.columns]
    gone = F.coalesce(F.col(clear), no_strings()) if clear in changes.columns else no_strings()
    p = changes.select(F.col(key).alias("_k"), gone.alias("_gone"), *[F.col(c).alias(f"_p_{c}") for c in cols if c in changes.columns])
    joined = base.join(p, base[key] == p["_k"], "left")

    def value(c: str) -> Column:
        if c not in cols or c not in base.columns:
            return F.col(c)
        new = F.coalesce(f"_p_{c}", c) if c in changes.columns else F.col(c)
        return F.when(F.coalesce(F.array_contains("_gone", c), F.lit(False)), F.lit(None)).otherwise(new).alias(c)

    return joined.select(*[value(c) for c in base.columns])


def upsert_chunks(existing: DataFrame | None, new: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejected): a chunk needs its document, and its parent, if it names one, among all chunks."""
    ids = documents.select(F.col("document_id").alias("_d")).distinct()
    placed = new.join(ids, new["document_id"] == ids["_d"], "left_semi")
    rows = upsert_rows(existing, placed, "chunk_id")
    parents = rows.select(F.col("chunk_id").alias("_c")).distinct()
    orphan = rows.filter("parent_chunk_id is not null").join(parents, F.col("parent_chunk_id") == F.col("_c"), "left_anti").select("chunk_id")
    lost = new.join(ids, new["document_id"] == ids["_d"], "left_anti").select("chunk_id").union(orphan).distinct()
    return rows.join(orphan, "chunk_id", "left_anti").select(*rows.columns), new.join(lost, "chunk_id", "left_semi").select(*new.columns)


def upsert_vectors(existing: DataFrame | None, new: DataFrame, size: int, key: str = "id", vec: str = "vec") -> DataFrame:
    """Vectors by key, the last writer wins; one of another length raises when it is read."""
    fits = F.when(F.size(vec) == size, F.col(vec)).otherwise(F.raise_error(F.concat(F.lit("vector of another length: "), F.col(key).cast("string"))))
    return upsert_rows(existing, new.withColumn(vec, fits), key)


def delete_keys(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(F.col(key)).distinct(), key, "left_anti")


def detach_delete(entities: DataFrame, edges: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities without the given ids, and edges without those that touch them."""
    gone = keys.select(F.col("id").alias("_g")).distinct()
    left = edges.join(gone, edges["source_entity_id"] == gone["_g"], "left_anti").join(gone, F.col("target_entity_id") == gone["_g"], "left_anti")
    return entities.join(gone, entities["id"] == gone["_g"], "left_anti"), left


def deactivate_document(rows: DataFrame, document_id: str) -> DataFrame:
    hit = F.array_contains("source_documents", document_id) if "source_documents" in rows.columns else F.col("document_id") == document_id
    return rows.withColumn("status", F.when(hit, "inactive").otherwise(F.col("status")))


def links(existing: DataFrame | None, new: DataFrame, left: str, right_list: str, right: str) -> DataFrame:
    """Bridge rows (left, right) from a list column, without duplicates."""
    rows = new.select(left, F.explode(right_list).alias(right))
    return (existing.select(left, right).unionByName(rows) if existing is not None else rows).distinct()


# ---------------------------------------------------------------- merging mentions


def noisy_or(confidence: Column, source: Column) -> Column:
    """1 - prod(1 - c), plus 0.05 if several sources agree, 1 at most."""
    return F.least(F.lit(1.0), 1 - F.product(1 - confidence) + F.when(F.count_distinct(source) > 1, 0.05).otherwise(0.0))


def type_vote(rows: DataFrame, keys: list[str], type_col: str = "type", weight: Column | None = None) -> DataFrame:
    """keys, type (most weight), conflicting_types (the others with any, sorted)."""
    weight = F.col("confidence") if weight is None else weight
    votes = rows.groupBy(*keys, type_col).agg(F.sum(weight).alias("v"))
    best = F.struct(F.round("v", 9).alias("v"), F.col(type_col).alias("t"))
    out = votes.groupBy(*keys).agg(
        F.max_by(F.col(type_col), F.struct(F.round("v", 9), F.col(type_col))).alias("type"), F.collect_list(best).alias("all")
    )
    others = F.transform(F.filter("all", lambda s: s["v"] > 0), lambda s: s["t"])
    return out.select(*keys, "type", F.array_sort(F.array_except(others, F.array("type"))).alias("conflicting_types"))


SOURCE_WEIGHT = {"llm": 1.0, "spacy": 0.9}


def merge_mentions(mentions: DataFrame, normalized: Column, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """Mentions of one chunk with the same normalised name, or bridged by an alias of it, become one candidate.

    Within a chunk a mention's group is its own name, or that of the mention which lists it
    as an alias, and so on over eight steps at most.
    """
    m = mentions if allowed is None else mentions.filter(F.col("type").isin(*allowed))
    m = m.withColumn("_n", normalized).withColumn("_a", F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(F.trim(a))))
    alias = m.select("chunk_id", F.col("_n").alias("_owner"), F.explode("_a").alias("_n")).filter("_n <> _owner").groupBy("chunk_id", "_n").agg(F.min("_owner").alias("_owner"))
    for _ in range(3):  # an owner's owner: the way doubles each time
        up = alias.select("chunk_id", F.col("_n").alias("_owner"), F.col("_owner").alias("_up"))
        alias = alias.join(up, ["chunk_id", "_owner"], "left").select("chunk_id", "_n", F.coalesce("_up", "_owner").alias("_owner"))
    m = m.join(alias, ["chunk_id", "_n"], "left").withColumn("_g", F.coalesce("_owner", "_n"))
    weight = F.col("confidence") * F.when(F.col("source") == "spacy", SOURCE_WEIGHT["spacy"]).otherwise(SOURCE_WEIGHT["llm"])
    kinds = type_vote(m, ["chunk_id", "_g"], weight=weight)
    folded = m.groupBy("chunk_id", "_g").agg(
        F.max_by("name", F.struct((F.col("source") != "spacy"), F.col("confidence"), "name")).alias("canonical_name"),
        F.count(F.lit(1)).alias("mention_count"),
        noisy_or(F.col("confidence"), F.col("source")).alias("confidence"),
        F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))), F.collect_list("name")))).alias("aliases"),
        F.max_by("description", F.length(F.coalesce("description", F.lit("")))).alias("description"),
        F.min("document_id").alias("document_id"),
    )
    out = folded.join(kinds, ["chunk_id", "_g"])
    return out.withColumn("aliases", F.array_except("aliases", F.array("canonical_name"))).withColumnRenamed("_g", "normalized_name")


def fold_survivors(rows: DataFrame, survivor: str = "survivor") -> DataFrame:
    """Auto-merge: one row a survivor with the highest confidence, all mentions, united aliases, the longest description."""
    return rows.groupBy(survivor).agg(
        F.max("confidence_score").alias("confidence_score"),
        F.sum("mention_count").alias("mention_count"),
        F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_list("aliases")), F.collect_list(F.when(F.col("candidate_key") != F.col(survivor), F.col("canonical_name")))))).alias("aliases"),
        F.max_by("description", F.struct(F.length(F.coalesce("description", F.lit(""))), "description")).alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunk_ids")))).alias("chunk_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_documents")))).alias("source_documents"),
        F.max_by("canonical_name", F.col("candidate_key") == F.col(survivor)).alias("canonical_name"),
    )


def dedup_fold(rows: DataFrame, key: str = "candidate_key") -> DataFrame:
    """Rows that share a key within a document: counted once per (document, key)."""
    return rows.groupBy("document_id", key).agg(
        F.sum("mention_count").alias("mention_count"),
        F.max("confidence_score").alias("confidence_score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
        F.min_by("description", "chunk_id").alias("description"),
    )


# ---------------------------------------------------------------- counts


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    one = lambda s: F.count_if(F.col(status) == s).alias(s)
    return rows.agg(F.count(F.lit(1)).alias("total"), one("pending"), one("approved"), one("rejected"))


def type_counts(rows: DataFrame, kind: str) -> DataFrame:
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), kind)


def filtered_total(rows: DataFrame, status: str | None = None, types: list[str] | None = None, least: float | None = None, kind: str = "candidate_type") -> DataFrame:
    return scan(rows, status, types, least, kind).agg(F.count(F.lit(1)).alias("n"))


def scan(rows: DataFrame, status: str | None = None, types: list[str] | None = None, least: float | None = None, kind: str = "candidate_type") -> DataFrame:
    """Filters that are None are left out of the plan, so the rest reach the files."""
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if types is not None:
        rows = rows.filter(F.col(kind).isin(*types))
    if least is not None:
        rows = rows.filter(F.col("confidence_score") >= least)
    return rows


def list_entities(entities: DataFrame, kind: str | None = None, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of the entities of a type and a status, by name."""
    rows = entities if kind is None else entities.filter(F.col("entity_type") == kind)
    rows = rows if status is None else rows.filter(F.col("status") == status)
    return rows.orderBy("canonical_name", "id").offset(offset).limit(limit)


def involving_keys(relations: DataFrame, keys: DataFrame, statuses: list[str] | None = None, limit: int | None = 200) -> DataFrame:
    """Relation candidates whose key begins with `k:` or ends with `:k` for any of the keys, which may hold colons.

    Every beginning and every end of a key that a colon cuts off meets the keys in one equi-join.
    """
    rows = relations if statuses is None else relations.filter(F.col("status").isin(*statuses))
    parts = F.split("candidate_key", ":")
    n = F.size(parts)
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array(F.array_join(F.slice(parts, F.lit(1), i), ":"), F.array_join(F.slice(parts, i + 1, n - i), ":")))
    ends = rows.filter(n > 1).select("candidate_key", F.explode(F.array_distinct(F.flatten(cuts))).alias("key"))
    hit = ends.join(keys.select("key").distinct(), "key", "left_semi").select("candidate_key").distinct()
    out = rows.join(hit, "candidate_key", "left_semi").select(*relations.columns)
    return out if limit is None else out.orderBy("candidate_key").limit(limit)


def top_entities(candidates: DataFrame, top: int = 50) -> DataFrame:
    """The most mentioned candidates."""
    return candidates.orderBy(F.desc("mention_count"), F.desc("confidence_score"), "candidate_key").limit(top)


def sorted_queue(rows: DataFrame, sort: str = "confidence", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a review queue, by confidence, mentions or name."""
    order = {"confidence": [F.desc("confidence_score"), F.desc("mention_count")], "mentions": [F.desc("mention_count"), F.desc("confidence_score")], "name": [F.lower("canonical_name")]}[sort]
    return rows.orderBy(*order, "candidate_key").offset(offset).limit(limit)


def topics_of(docs: DataFrame, topic: str = "topic") -> DataFrame:
    """The topics that documents have, once each."""
    return docs.filter(F.col(topic).isNotNull()).select(topic).distinct()


def of_topics(docs: DataFrame, topics: list[str], topic: str = "topic") -> DataFrame:
    """Documents of any of the topics."""
    return docs.filter(F.col(topic).isin(*topics))


def duplicate_checksums(docs: DataFrame, checksum: Column, id_col: str) -> DataFrame:
    """checksum, n, first identifier of contents that several documents have."""
    return docs.groupBy(checksum.alias("checksum")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias(id_col)).filter("n > 1")


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(F.desc("confidence_score"), F.desc("mention_count"), "candidate_key").offset(offset).limit(limit)


def graph_statistics(entities: DataFrame, edges: DataFrame, types: tuple[str, ...] = C.ENTITY_TYPES, relations: tuple[str, ...] = C.RELATIONSHIP_TYPES) -> DataFrame:
    """(section, name, n) with zeros for types that don't occur, and totals."""
    spark = entities.sparkSession
    known = lambda section, names: spark.range(1).select(F.lit(section).alias("section"), F.explode(F.array(*map(F.lit, names))).alias("name"))
    nodes = entities.groupBy(F.col("entity_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    lines = edges.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    each = [known(s, names).join(F.broadcast(counts), "name", "left").select("section", "name", F.coalesce("n", F.lit(0)).alias("n")) for s, names, counts in (("entity", types, nodes), ("relationship", relations, lines))]
    total = lambda section, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), F.lit("total").alias("name"), "n")
    return each[0].union(each[1]).union(total("entity", entities)).union(total("relationship", edges))


def corpus_statistics(candidates: DataFrame) -> DataFrame:
    """candidates, distinct chunks and documents; no per-candidate list is gathered."""
    chunks = candidates.select(F.explode("chunk_ids").alias("x")).agg(F.count_distinct("x").alias("chunks"))
    docs = candidates.select(F.explode("source_documents").alias("x")).agg(F.count_distinct("x").alias("documents"))
    return candidates.agg(F.count(F.lit(1)).alias("candidates"), F.sum("mention_count").alias("mentions")).crossJoin(chunks).crossJoin(docs)


def unknown_types(candidates: DataFrame, known: list[str], top: int = 25, examples: int = 5) -> DataFrame:
    """Labels that are no known type: how often, and the first few names."""
    labels = candidates.select("canonical_name", F.explode("conflicting_types").alias("t")).select("canonical_name", F.upper(F.trim("t")).alias("label"))
    odd = labels.filter(~F.col("label").isin(*[k.upper() for k in known])).filter("label <> ''")
    ranked = odd.distinct().withColumn("r", F.row_number().over(W.partitionBy("label").orderBy("canonical_name"))).filter(F.col("r") <= examples)
    names = ranked.groupBy("label").agg(F.array_sort(F.collect_list("canonical_name")).alias("examples"))
    return odd.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(names, "label").orderBy(F.desc("n"), "label").limit(top)


def prune_weak(rows: DataFrame, below: float = 0.5, kind: str | None = None) -> DataFrame:
    weak = (F.col("status") == "pending") & (F.col("confidence_score") < below)
    weak = weak if kind is None else weak & (F.col("type") == kind)
    return rows.withColumn("status", F.when(weak, "rejected").otherwise(F.col("status")))
