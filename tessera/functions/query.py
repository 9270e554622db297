"""Understanding questions: one row a question, columns for what is asked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from . import text as X

INTENTS = ("semantic", "structural", "procedural")


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def intent_hits(question: Column, family: str) -> Column:
    return sum((question.rlike("(?i)" + p).cast("int") for p in C.INTENT_PATTERNS[family]), F.lit(0))


def intent(question: Column) -> Column:
    """struct(intent, confidence): two families make hybrid .8, one .9, a question word .7, else semantic .5."""
    hit = {k: intent_hits(question, k) > 0 for k in INTENTS}
    families = sum((h.cast("int") for h in hit.values()), F.lit(0))
    first = F.lower(F.regexp_extract(question, r"^\s*(\w+)", 1))
    how_to = question.rlike(r"(?i)^\s*how\s+to\b")
    name = (
        F.when(families >= 2, "hybrid")
        .when(hit["semantic"], "semantic")
        .when(hit["structural"], "structural")
        .when(hit["procedural"], "procedural")
        .when((first == "how") & how_to, "procedural")
        .otherwise("semantic")
    )
    sure = F.when(families >= 2, 0.8).when(families == 1, 0.9).when(first.isin("what", "who", "how"), 0.7).otherwise(0.5)
    return F.struct(name.alias("intent"), sure.alias("confidence"))


def relationship_types(question: Column) -> Column:
    low = F.lower(question)
    found = F.array(*[F.when(low.contains(k), F.lit(v)) for k, v in C.RELATIONSHIP_KEYWORDS.items()])
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def constraints(question: Column) -> Column:
    """array of struct(field, operator, value), pattern by pattern."""
    one = lambda p, op, field: F.transform(
        F.regexp_extract_all(question, F.lit("(?i)" + p), F.lit(1)), lambda v: F.struct(F.lit(field).alias("field"), F.lit(op).alias("operator"), v.alias("value"))
    )
    return F.flatten(F.array(*[one(p, op, field) for p, op, field in C.CONSTRAINT_PATTERNS]))


def expansions(question: Column) -> Column:
    """map term -> synonyms for the terms that the question has as words."""
    low = F.lower(question)
    entries = [F.when(low.rlike(rf"\b{t}\b"), F.struct(F.lit(t).alias("key"), F.array(*map(F.lit, s)).alias("value"))) for t, s in C.SYNONYMS.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def acronym_expansions(question: Column, dictionary: dict[str, tuple[str, ...]]) -> Column:
    """map acronym -> its long forms, for the acronyms of a fixed dictionary that the question has as words."""
    entries = [F.when(question.rlike(rf"\b{a}\b"), F.struct(F.lit(a).alias("key"), F.array(*map(F.lit, long)).alias("value"))) for a, long in dictionary.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull())) if entries else F.create_map().cast("map<string,array<string>>")


def enriched(question: Column, *expanded: Column) -> Column:
    """The question followed by its expansions in brackets, once each."""
    more = F.array_sort(F.array_distinct(F.flatten(F.concat(*[F.map_values(e) for e in expanded]))))
    return F.when(F.size(more) > 0, F.concat(question, F.lit(" ("), F.array_join(more, ", "), F.lit(")"))).otherwise(question)


def needs_graph(intent_name: Column, types: Column, question: Column) -> Column:
    low = F.lower(question)
    return intent_name.isin("structural", "hybrid") | (F.size(types) > 0) | any_of([low.contains(w) for w in C.GRAPH_WORDS])


def max_depth(question: Column, default: int = 3) -> Column:
    told = F.regexp_extract(question, r"(?i)\b(\d+)\s*(?:levels?|hops?|degrees?)\b", 1)
    near = F.lower(question).rlike("direct|immediate|first")
    return F.coalesce(told.try_cast("int"), F.when(near, F.lit(1)), F.lit(default))


def is_complex(intent_name: Column, types: Column, question: Column) -> Column:
    low = F.lower(question)
    return (
        intent_name.isin("hybrid", "procedural")
        | any_of([low.contains(w) for w in C.DEEP_WORDS])
        | (F.size(types) > 1)
        | (X.word_count(question) > 15)
    )


def problem(intent_name: Column, confidence: Column, question: Column) -> Column:
    return F.when(X.word_count(question) < 2, "too short").when((intent_name == "unknown") | (confidence < 0.3), "no intent")


def mentions(question: Column) -> Column:
    """Runs of capitalised words, acronyms and gazetteer terms; the offline stand-in for a language model."""
    names = F.regexp_extract_all(question, F.lit(r"\b[A-Z][A-Za-z0-9]*(?:[ -][A-Z][A-Za-z0-9]*)*\b"), F.lit(0))
    names = F.filter(names, lambda n: ~F.lower(n).isin("what", "who", "where", "when", "why", "how", "which", "the", "a", "an", "is", "are", "does", "do"))
    low = F.lower(question)
    terms = [F.when(low.rlike(rf"\b{t}\b"), F.lit(t)) for group in C.GAZETTEER.values() for t in group]
    return F.array_distinct(F.concat(names, F.filter(F.array(*terms), lambda t: t.isNotNull())))


def keywords(question: Column, stop: tuple[str, ...] = ("what", "which", "with", "from", "that", "this", "does", "have", "about", "into", "their", "there", "where", "when")) -> Column:
    found = F.regexp_extract_all(F.lower(question), F.lit(r"\b[a-z][a-z0-9-]{3,}\b"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*stop)))


def topic(question: Column, topics: list[str]) -> Column:
    """The first of a fixed list of topics that the question names."""
    low = F.lower(question)
    return F.coalesce(*[F.when(low.contains(t.lower()), F.lit(t)) for t in topics], F.lit(None).cast("string"))


def retrieval_strategy(intent_name: Column, n_mentions: Column, graph: Column) -> Column:
    return (
        F.when((intent_name == "semantic") & (n_mentions == 0), "vector_only")
        .when((intent_name == "structural") & (n_mentions > 0), "graph_first")
        .when(intent_name == "procedural", "graph_first")
        .otherwise("hybrid_parallel")
    )


def traversal_strategy(types: Column, n_mentions: Column) -> Column:
    has = lambda *ts: any_of([F.array_contains(types, t) for t in ts])
    return (
        F.when(has("PRECEDES"), "sequential")
        .when(has("REFERENCES"), "procedural")
        .when(has("CONTAINS", "PART_OF"), "hierarchical")
        .when(n_mentions >= 2, "shortest_path")
        .otherwise("multi_hop")
    )


def query_id(question: Column, at: Column) -> Column:
    return F.concat(F.lit("query_"), F.date_format(at, "yyyyMMddHHmmss"), F.lit("_"), F.substring(F.md5(question), 1, 12))


def parse(questions: DataFrame, text_col: str = "text", depth: int = 3) -> DataFrame:
    """questions with normalized_text, intent, intent_confidence, relationship_types, constraints, expanded_terms, ... added."""
    q = questions.withColumn("normalized_text", X.normalize_query(F.col(text_col)))
    t = F.col("normalized_text")
    q = q.withColumn("_i", intent(t)).withColumns({"intent": F.col("_i.intent"), "intent_confidence": F.col("_i.confidence")}).drop("_i")
    q = q.withColumns(
        {"relationship_types": relationship_types(t), "constraints": constraints(t), "expanded_terms": expansions(t), "entity_mentions": mentions(F.col(text_col)), "keywords": keywords(t), "max_depth": max_depth(t, depth)}
    )
    graph = needs_graph(F.col("intent"), F.col("relationship_types"), t)
    q = q.withColumn("requires_graph_traversal", graph)
    return q.withColumns(
        {
            "is_complex": is_complex(F.col("intent"), F.col("relationship_types"), F.col(text_col)),
            "strategy": retrieval_strategy(F.col("intent"), F.size("entity_mentions"), F.col("requires_graph_traversal")),
            "traversal": traversal_strategy(F.col("relationship_types"), F.size("entity_mentions")),
            "problem": problem(F.col("intent"), F.col("intent_confidence"), F.col(text_col)),
        }
    )
