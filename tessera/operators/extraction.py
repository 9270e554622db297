"""Table-generating extractors: relations, mentions, acronyms; validation of relations."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import similarity as S
from ..functions import text as X

RELATION = "chunk_id string, document_id string, source string, target string, type string, confidence double, method string"


def pattern_relations(chunks: DataFrame, phrases=C.RELATION_PHRASES, longest: int = 50, confidence: float = 0.8) -> DataFrame:
    """Relations stated by fixed phrases; every pattern's matches, left to right without overlap; no self-relations."""
    # A match holds no other characters than these, so pieces between others are matched one by one, and only those with a phrase.
    any_phrase = "(?i)" + "|".join(p for _, p, _ in phrases)
    pieces = chunks.filter(F.col("content").rlike(any_phrase)).select("chunk_id", "document_id", F.explode(F.split("content", r"[^A-Za-z0-9 _,-]+")).alias("piece"))
    pieces = pieces.filter(F.col("piece").rlike(any_phrase))
    parts = []
    for kind, phrase, swapped in phrases:
        pattern = f"(?i)({C.RELATION_NAME}){phrase}({C.RELATION_NAME})"
        ends = (2, 1) if swapped else (1, 2)
        hits = F.arrays_zip(*[F.regexp_extract_all("piece", F.lit(pattern), F.lit(g)).alias(n) for g, n in zip(ends, ("source", "target"))])
        parts.append(F.when(F.col("piece").rlike("(?i)" + phrase), _typed(hits, kind)).otherwise(F.array().cast("array<struct<source:string,target:string,type:string>>")))
    rows = pieces.select("chunk_id", "document_id", F.explode(F.flatten(F.array(*parts))).alias("r")).select("chunk_id", "document_id", "r.*")
    ok = (F.lower("source") != F.lower("target")) & (F.char_length("source") <= longest) & (F.char_length("target") <= longest) & (F.col("source") != "") & (F.col("target") != "")
    return rows.filter(ok).select("chunk_id", "document_id", "source", "target", "type", F.lit(confidence).alias("confidence"), F.lit("rule").alias("method"))


def _typed(hits: Column, kind: str) -> Column:
    return F.transform(hits, lambda h: F.struct(F.trim(h["source"]).alias("source"), F.trim(h["target"]).alias("target"), F.lit(kind).alias("type")))


def verb_relations(chunks: DataFrame, confidence: float = 0.7, longest: int = 50) -> DataFrame:
    """Subject, verb, object by a table of verb forms; the offline stand-in for a dependency parser."""
    forms = {}
    for lemma, kind in C.VERB_TYPES.items():
        stem = lemma[:-1] if lemma.endswith("e") else lemma
        for f in (lemma, lemma + "s", stem + "ed", *(["controlled"] if lemma == "control" else [])):
            forms[f] = kind
    verbs = "|".join(sorted(forms, key=len, reverse=True))
    np = r"((?:the |a |an )?[A-Za-z][A-Za-z0-9-]*(?: [A-Za-z0-9-]+){0,3}?)"
    pattern = rf"(?i)\b{np} ({verbs}) ((?:the |a |an )?[A-Za-z][A-Za-z0-9-]*(?: [A-Za-z0-9-]+){{0,2}})"
    hits = F.arrays_zip(*[F.regexp_extract_all("piece", F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "s"), (2, "v"), (3, "o"))])
    kinds = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    said = rf"(?i) (?:{verbs}) "
    pieces = chunks.filter(F.col("content").rlike(said)).select("chunk_id", "document_id", F.explode(F.split("content", r"[^A-Za-z0-9 -]+")).alias("piece"))
    rows = pieces.filter(F.col("piece").rlike(said)).select("chunk_id", "document_id", F.explode(hits).alias("h")).select(
        "chunk_id", "document_id", F.trim("h.s").alias("source"), F.trim("h.o").alias("target"), kinds[F.lower("h.v")].alias("type")
    )
    return rows.filter((F.lower("source") != F.lower("target")) & (F.char_length("source") <= longest) & (F.char_length("target") <= longest)).select(
        "*", F.lit(confidence).alias("confidence"), F.lit("dependency").alias("method")
    )


def gazetteer_mentions(chunks: DataFrame, gazetteer: dict[str, tuple[str, ...]] | None = None, least: float = 0.5) -> DataFrame:
    """Mentions of gazetteer terms: of overlapping ones the longest; confidence from length, context, type and digits."""
    gazetteer = gazetteer or C.GAZETTEER
    kind_of = {t: k for k, terms in gazetteer.items() for t in terms}
    terms = sorted(kind_of, key=lambda t: (-len(t), t))  # the alternation tries longer terms first
    pattern = r"(?i)\b(?:" + "|".join(t.replace(" ", r"\s+") for t in terms) + r")\b"
    found = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
    gaps = F.split("content", pattern, -1)
    pieces = chunks.filter(F.col("content").rlike(pattern)).select("chunk_id", "document_id", found.alias("ms"), gaps.alias("gs"))
    each = pieces.select("chunk_id", "document_id", F.posexplode(_with_context(F.col("gs"), F.col("ms"), 80)).alias("p", "x"))
    end = F.sum(F.char_length("x.g") + F.coalesce(F.char_length("x.m"), F.lit(0))).over(W.partitionBy("chunk_id").orderBy("p"))
    each = each.withColumn("end_char", end).filter("x.m is not null").withColumn("name", F.col("x.m"))
    each = each.withColumn("start_char", F.col("end_char") - F.char_length("name"))
    kinds = F.create_map(*[F.lit(x) for kv in kind_of.items() for x in kv])
    each = each.withColumn("type", kinds[F.regexp_replace(F.lower("name"), r"\s+", " ")])
    each = each.withColumn("context", F.col("x.c"))
    return each.withColumn("confidence", mention_confidence(F.lit(0.68), F.col("name"), F.col("type"), F.col("context"))).filter(F.col("confidence") >= least).select(
        "name", "type", F.lit(None).cast("string").alias("description"), F.array().cast("array<string>").alias("aliases"), "confidence", "chunk_id", "document_id",
        F.lit("spacy").alias("source"), F.col("start_char").cast("int").alias("start_char"), F.col("end_char").cast("int").alias("end_char"), "context",
    )


def _with_context(gaps: Column, matches: Column, window: int) -> Column:
    """array of struct(g, m, c): each gap, the match after it, and the match with `window` characters on either side.

    So much of a text, and no more, goes along with a match. A match has a character at
    least, so as many pieces on either side hold the window.
    """
    flat = F.flatten(F.zip_with(gaps, matches, lambda g, m: F.array(g, F.coalesce(m, F.lit("")))))

    def one(f: Column, i: Column) -> Column:
        first = F.greatest(F.lit(1), 2 * i + 1 - 2 * window)
        before = F.right(F.array_join(F.slice(f, first, 2 * i + 2 - first), ""), F.lit(window))
        after = F.left(F.array_join(F.slice(f, 2 * i + 3, F.lit(2 * window + 1)), ""), F.lit(window))
        m = F.get(matches, i)
        return F.struct(F.get(gaps, i).alias("g"), m.alias("m"), F.trim(F.concat(before, m, after)).alias("c"))

    of = lambda f: F.transform(F.sequence(F.lit(0), F.size(gaps) - 1), lambda i: one(f, i))
    return F.get(F.transform(F.array(flat), of), F.lit(0))


def mention_confidence(base: Column, name: Column, kind: Column, context: Column) -> Column:
    low = F.lower(context)
    salient = F.lit(False)
    for w in C.SALIENT:
        salient = salient | low.contains(w)
    score = (
        base
        + F.least(F.char_length(name) / 50, F.lit(0.10))
        + F.when(salient, 0.05).otherwise(0.0)
        + F.when(kind.isin("SYSTEM", "SUBSYSTEM", "COMPONENT"), 0.05).otherwise(0.0)
        - F.when(~kind.isin("PARAMETER", "ANOMALY") & name.rlike("[0-9]"), 0.05).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def endpoint_mentions(relations: DataFrame, known: DataFrame, normalized=F.lower, factor: float = 0.8) -> DataFrame:
    """Ends of relations that no mention of their chunk names, as new mentions."""
    ends = relations.select("chunk_id", "document_id", F.explode(F.array("source", "target")).alias("name"), "confidence")
    ends = ends.withColumn("_n", normalized(F.trim("name")))
    fresh = ends.join(known.select("chunk_id", normalized(F.trim("name")).alias("_n")).distinct(), ["chunk_id", "_n"], "left_anti")
    return fresh.groupBy("chunk_id", "document_id", "_n").agg(F.min("name").alias("name"), (factor * F.max("confidence")).alias("confidence")).drop("_n").withColumn("source", F.lit("llm_discovery"))


def propagate_to_children(parents: DataFrame, children: DataFrame) -> DataFrame:
    """A parent chunk's mention belongs to each child that contains its name or an alias."""
    j = parents.select(F.col("chunk_id").alias("parent_chunk_id"), "name", "type", "aliases", "confidence").join(children.select("chunk_id", "parent_chunk_id", F.lower("content").alias("low")), "parent_chunk_id")
    hit = F.col("low").contains(F.lower("name")) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.col("low"), F.lower(a)))
    return j.filter(hit).select("chunk_id", "name", "type", "aliases", "confidence")


def validate_relations(relations: DataFrame, mentions: DataFrame, least: float = 0.5, threshold: float = 0.85, longest: int = 100) -> DataFrame:
    """relations with `reason`, null where valid; the first rule that fails names it.

    An end must be like a known name of its chunk; only distinct (chunk, end, name) pairs are scored.
    """
    r = relations.withColumn("_id", F.xxhash64("chunk_id", "source", "target", "type"))
    ends = r.select("chunk_id", F.explode(F.array("source", "target")).alias("end")).distinct()
    names = mentions.select("chunk_id", F.lower(F.trim("name")).alias("name")).distinct()
    scored = ends.join(names, "chunk_id").withColumn("score", S.fuzzy_ratio(F.lower(F.trim("end")), F.col("name")))
    known = scored.groupBy("chunk_id", "end").agg(F.max("score").alias("best"))
    j = r.join(known.withColumnsRenamed({"end": "source", "best": "sb"}), ["chunk_id", "source"], "left").join(known.withColumnsRenamed({"end": "target", "best": "tb"}), ["chunk_id", "target"], "left")
    adjective = F.lit(False)
    for a in C.ADJECTIVES:
        adjective = adjective | F.lower("target").contains(a)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = (
        F.when(blank("source") | blank("target") | blank("type"), "missing field")
        .when(F.coalesce("confidence", F.lit(0.0)) < least, "low confidence")
        .when(F.char_length("source") > longest, "source name too long")
        .when(F.char_length("target") > longest, "target name too long")
        .when((F.col("type") == "IS_A") & adjective, "target is an adjective")
        .when(F.coalesce("sb", F.lit(0.0)) < threshold, "source not known")
        .when(F.coalesce("tb", F.lit(0.0)) < threshold, "target not known")
    )
    return j.withColumn("reason", reason).select(*relations.columns, "reason")


# ---------------------------------------------------------------- acronyms


def acronym_definitions(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """id, acronym, expansion, context: `Long form (LF)` and `LF (long form)`."""
    # Both forms stand around one opening bracket: 120 characters on either side hold them.
    parts = F.split(text_col, r"\(")
    around = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.right(F.get(parts, i - 1), F.lit(120)), F.lit("("), F.left(F.get(parts, i), F.lit(120))))
    near = chunks.filter(F.col(text_col).contains("(")).select(id_col, text_col, F.explode(around).alias("_near"))
    out = None
    for pattern, a, e in ((C.ACRONYM_BEFORE, 2, 1), (C.ACRONYM_AFTER, 1, 2)):
        hits = F.arrays_zip(*[F.regexp_extract_all("_near", F.lit(pattern), F.lit(g)).alias(n) for g, n in ((a, "a"), (e, "e"), (0, "m"))])
        rows = near.select(id_col, text_col, F.explode(hits).alias("h")).select(
            id_col, F.col("h.a").alias("acronym"), X.clean_expansion(F.col("h.e")).alias("expansion"),
            X.sentence_context(F.col(text_col), F.instr(F.col(text_col), F.col("h.m")) - 1, F.instr(F.col(text_col), F.col("h.m")) - 1 + F.char_length("h.m")).alias("context"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out.filter(X.is_acronym(F.col("acronym")) & (F.col("expansion") != "") & (F.lower("expansion") != F.lower("acronym")))


def acronym_tokens(chunks: DataFrame) -> DataFrame:
    """chunk_id, acronym, n: what looks like an acronym, and how often each chunk has it."""
    each = chunks.select("chunk_id", F.explode(F.regexp_extract_all("content", F.lit(C.ACRONYM), F.lit(0))).alias("acronym"))
    return each.filter(X.is_acronym(F.col("acronym"))).groupBy("chunk_id", "acronym").agg(F.count(F.lit(1)).alias("n"))


def acronym_dictionary(definitions: DataFrame, contexts: int = 10, old: DataFrame | None = None) -> DataFrame:
    """acronym, expansion, n, share of the acronym's definitions, up to ten contexts; `old` is added to."""
    ranked = definitions.withColumn("r", F.row_number().over(W.partitionBy("acronym", "expansion").orderBy("context")))
    new = ranked.groupBy("acronym", "expansion").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= contexts, F.col("context")))).alias("contexts"))
    if old is not None:
        both = old.select("acronym", "expansion", "n", "contexts").unionByName(new)
        new = both.groupBy("acronym", "expansion").agg(F.sum("n").alias("n"), F.slice(F.array_distinct(F.flatten(F.collect_list("contexts"))), 1, contexts).alias("contexts"))
    return new.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("acronym")))


def resolve_acronyms(asked: DataFrame, dictionary: DataFrame, overrides: dict[str, str] | None = None, least: float = 0.2) -> DataFrame:
    """asked (id, acronym, context) -> expansion, confidence, method: overrides at .95, else .6 context + .4 share, a sole expansion 1."""
    overrides = C.ACRONYM_OVERRIDES if overrides is None else overrides
    fixed = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv]) if overrides else F.lit(None).cast("map<string,string>")
    manual = asked.withColumn("expansion", F.try_element_at(fixed, F.col("acronym"))).filter("expansion is not null").select("id", "acronym", "expansion", F.lit(0.95).alias("confidence"), F.lit("override").alias("method"))
    rest = asked.join(manual.select("id", "acronym"), ["id", "acronym"], "left_anti")
    cand = rest.join(dictionary, "acronym").withColumn("k", F.count(F.lit(1)).over(W.partitionBy("id", "acronym")))
    near = cand.select("id", "acronym", "expansion", "context", "share", "k", F.explode_outer("contexts").alias("c"))
    near = near.withColumn("sim", F.when(F.coalesce(F.trim("context"), F.lit("")) == "", None).otherwise(S.fuzzy_token_set(F.lower("context"), F.lower(F.coalesce("c", F.lit(""))))))
    scored = near.groupBy("id", "acronym", "expansion", "share", "k").agg(F.max("sim").alias("sim"))
    score = F.when(F.col("k") == 1, F.lit(1.0)).otherwise(F.when(F.col("sim").isNull(), F.col("share")).otherwise(0.6 * F.col("sim") + 0.4 * F.col("share")))
    best = scored.withColumn("score", score).groupBy("id", "acronym").agg(F.max_by(F.struct("expansion", "score"), F.struct("score", "share", "expansion")).alias("b"))
    learned = best.select("id", "acronym", "b.expansion", F.col("b.score").alias("confidence"), F.lit("dictionary").alias("method")).filter(F.col("confidence") >= least)
    return manual.unionByName(learned)


def expand_aliases(mentions: DataFrame, resolved: DataFrame) -> DataFrame:
    """aliases with the acronyms in the name written out; resolved (chunk_id, acronym, expansion)."""
    pairs = resolved.groupBy("chunk_id").agg(F.collect_list(F.struct("acronym", "expansion")).alias("_x"))
    j = mentions.join(pairs, "chunk_id", "left")
    said = F.transform(F.filter("_x", lambda x: F.contains(F.col("name"), x["acronym"])), lambda x: F.replace(F.col("name"), x["acronym"], x["expansion"]))
    none = F.array().cast("array<string>")
    return j.withColumn("aliases", F.array_union(F.coalesce("aliases", none), F.coalesce(said, none))).drop("_x")


# ---------------------------------------------------------------- model plug-ins


def with_model(chunks: DataFrame, call: Callable[[str], str], schema: str, parse: Callable[[str], list[dict]], retries: int = 3, wait=lambda seconds: None) -> DataFrame:
    """Rows that a text model returns for each chunk; `call` is the caller's client, retried with doubling waits.

    A chunk whose calls all fail gives no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in frames:
            rows = []
            for chunk, doc, text in zip(pdf["chunk_id"], pdf["document_id"], pdf["content"]):
                for attempt in range(retries + 1):
                    try:
                        rows += [{"chunk_id": chunk, "document_id": doc} | r for r in parse(call(text))]
                        break
                    except Exception:
                        if attempt < retries:
                            wait(2.0**attempt)
            yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)

    return chunks.select("chunk_id", "document_id", "content").mapInPandas(run, schema)


def first_json(text: str):
    """The first JSON object or array in a reply, whatever stands around it; None without one."""
    decoder = json.JSONDecoder()
    for i, c in enumerate(text or ""):
        if c in "{[":
            try:
                return decoder.raw_decode(text, i)[0]
            except json.JSONDecodeError:
                continue
    return None


def entities_of(reply: str) -> list[dict]:
    """Entities of a reply under any of the usual names; confidence clamped to [0, 1]."""
    data = first_json(reply)
    rows = data.get("entities", []) if isinstance(data, dict) else data or []
    out = []
    for r in rows:
        name = next((str(r[k]).strip() for k in ("name", "canonical_name", "entity", "text") if isinstance(r, dict) and r.get(k)), "")
        if name:
            aliases = r.get("aliases") or []
            aliases = [a.strip() for a in (aliases.split(",") if isinstance(aliases, str) else map(str, aliases)) if a.strip()]
            out.append({"name": name, "type": str(r.get("type") or r.get("entity_type") or "CONCEPT").upper(), "aliases": aliases, "description": r.get("description"), "confidence": _clamp(r.get("confidence"))})
    return out


def relations_of(reply: str) -> list[dict]:
    data = first_json(reply)
    rows = data.get("relationships", []) if isinstance(data, dict) else data or []
    pick = lambda r, *ks: next((str(r[k]).strip() for k in ks if r.get(k)), "")
    out = [{"source": pick(r, "source", "source_entity", "from"), "target": pick(r, "target", "target_entity", "to"), "type": pick(r, "type", "relationship_type", "relation").upper(), "confidence": _clamp(r.get("confidence"))} for r in rows if isinstance(r, dict)]
    return [r for r in out if r["source"] and r["target"] and r["type"] and r["source"].lower() != r["target"].lower()]


def _clamp(value) -> float:
    try:
        return max(0.0, min(1.0, float(value)))
    except (TypeError, ValueError):
        return 0.5
