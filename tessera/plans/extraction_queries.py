"""Extraction, acronyms, text functions and questions over sentences made from the order tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import query as Q
from ..functions import similarity as S
from ..functions import text as X
from ..operators import candidates as K
from ..operators import chunking as H
from ..operators import extraction as E
from ..operators import retrieval as R
from .registry import query, table
from .storage_queries import s

# ---------------------------------------------------------------- relations and mentions


def sentences(spark, sf):
    """Parts as chunks: a statement about part and brand, by the part's number."""
    k = F.col("p_partkey") % 6
    name = F.concat(F.lit("Unit "), s("p_partkey"))
    brand = F.concat(F.lit("Rack "), F.regexp_replace("p_brand", "#", " "))
    said = (
        F.when(k == 0, F.concat(name, F.lit(" is a part of "), brand)).when(k == 1, F.concat(brand, F.lit(" contains "), name)).when(k == 2, F.concat(brand, F.lit(" consists of "), name))
        .when(k == 3, F.concat(name, F.lit(" monitors "), name)).when(k == 4, F.concat(name, F.lit(" is a type of "), brand)).otherwise(F.concat(name, F.lit(" of "), brand))
    )
    return table(spark, sf, "part").select(s("p_partkey").alias("chunk_id"), F.col("p_brand").alias("document_id"), F.concat(said, F.lit(". Nothing else; here.")).alias("content"))


UNIT, RACK = "'Unit ' || p_partkey", "'Rack ' || replace(p_brand, '#', ' ')"


@query(f"""
SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, CASE p_partkey % 6 WHEN 0 THEN {UNIT} WHEN 1 THEN {RACK} WHEN 2 THEN {UNIT} ELSE {UNIT} END AS source,
       CASE p_partkey % 6 WHEN 0 THEN {RACK} WHEN 1 THEN {UNIT} WHEN 2 THEN {RACK} ELSE {RACK} END AS target, CASE p_partkey % 6 WHEN 0 THEN 'PART_OF' WHEN 1 THEN 'CONTAINS' WHEN 2 THEN 'PART_OF' ELSE 'IS_A' END AS type
FROM part WHERE p_partkey % 6 IN (0, 1, 2, 4)""")
def pattern_relations(spark, sf):
    """Stated relations; one about itself is none."""
    return E.pattern_relations(sentences(spark, sf)).select("chunk_id", "source", "target", "type")


@query(f"""
SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, {RACK} AS source, {UNIT} AS target, 'CONTAINS' AS type FROM part WHERE p_partkey % 6 = 1""")
def verb_relations(spark, sf):
    return E.verb_relations(sentences(spark, sf)).select("chunk_id", "source", "target", "type")


@query(f"""
SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, {RACK} AS name, 0.64 + 0.0 AS confidence FROM part WHERE p_partkey % 6 IN (0, 1, 2, 4)""".replace("0.64 + 0.0", "CAST(0.64 AS DOUBLE)"))
def endpoint_mentions(spark, sf):
    """Ends of relations that no mention names: the units are known, the racks aren't."""
    known = table(spark, sf, "part").select(s("p_partkey").alias("chunk_id"), F.concat(F.lit("UNIT "), s("p_partkey")).alias("name"))
    return E.endpoint_mentions(E.pattern_relations(sentences(spark, sf)), known).select("chunk_id", "name", F.round("confidence", 6).alias("confidence"))


def judged(spark, sf):
    """Relations of parts, most of which break one rule."""
    k = F.col("p_partkey")
    text = lambda c: F.concat(F.lit(c), k.cast("string"))
    rows = table(spark, sf, "part").select(
        k.cast("string").alias("chunk_id"), F.when(k % 8 == 1, F.lit("")).when(k % 8 == 3, F.repeat(F.lit("x"), F.lit(101))).when(k % 8 == 6, F.lit("stranger")).otherwise(text("source part ")).alias("source"),
        F.when(k % 8 == 4, F.lit("critical part")).when(k % 8 == 7, F.lit("somebody")).otherwise(text("target part ")).alias("target"), F.when(k % 8 == 4, "IS_A").otherwise("CONTAINS").alias("type"), F.when(k % 8 == 2, 0.3).otherwise(0.8).alias("confidence"),
    )
    names = table(spark, sf, "part").select(k.cast("string").alias("chunk_id"), F.explode(F.array(text("Source Part "), text("target part "))).alias("name"))
    return rows, names


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, CASE p_partkey % 8 WHEN 1 THEN 'missing field' WHEN 2 THEN 'low confidence' WHEN 3 THEN 'source name too long' WHEN 4 THEN 'target is an adjective' WHEN 6 THEN 'source not known' WHEN 7 THEN 'target not known' END AS reason FROM part""")
def validated_relations(spark, sf):
    return E.validate_relations(*judged(spark, sf)).select("chunk_id", "reason")


@query("""
SELECT o_orderkey AS child, 'customer ' || o_custkey AS name FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) AND o_orderkey % 3 < 2""")
def propagated_mentions(spark, sf):
    """A customer's mention belongs to the orders whose text has its name or its alias."""
    parents = table(spark, sf, "customer").select(s("c_custkey").alias("chunk_id"), F.concat(F.lit("customer "), s("c_custkey")).alias("name"), F.lit("ORG").alias("type"), F.array(F.concat(F.lit("Client No "), s("c_custkey"), F.lit(";"))).alias("aliases"), F.lit(0.5).alias("confidence"))
    k = F.col("o_orderkey") % 3
    said = F.when(k == 0, F.concat(F.lit("for CUSTOMER "), s("o_custkey"))).when(k == 1, F.concat(F.lit("see client no "), s("o_custkey"), F.lit(";"))).otherwise(F.lit("nobody"))
    children = table(spark, sf, "orders").select(s("o_orderkey").alias("chunk_id"), s("o_custkey").alias("parent_chunk_id"), said.alias("content"))
    return E.propagate_to_children(parents, children).select(F.col("chunk_id").cast("long").alias("child"), "name")


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS chunk_id, count(*) AS mention_count, round(least(1.0, 1 - product(1 - c) + CASE WHEN count(DISTINCT src) > 1 THEN 0.05 ELSE 0 END), 6) AS confidence,
       CAST(len(list_distinct(list('name ' || o_orderkey))) - 1 AS BIGINT) AS aliases
FROM (SELECT *, (o_orderkey % 9) / 10.0 AS c, CASE WHEN o_orderkey % 2 = 0 THEN 'spacy' ELSE 'llm' END AS src FROM orders) GROUP BY o_custkey""")
def merged_mentions(spark, sf):
    """Mentions of a customer's chunk, all bridged by one alias, are one candidate."""
    k = F.col("o_orderkey")
    one = F.min("o_orderkey").over(W.partitionBy("o_custkey"))
    rows = table(spark, sf, "orders").withColumn("first", one)
    others = F.col("o_orderkey") != F.col("first")
    m = rows.select(
        s("o_custkey").alias("chunk_id"), F.lit("d").alias("document_id"), F.concat(F.lit("name "), k.cast("string")).alias("name"), F.lit("SYSTEM").alias("type"), F.array().cast("array<string>").alias("aliases"), ((k % 9) / 10.0).alias("confidence"),
        F.when(k % 2 == 0, "spacy").otherwise("llm").alias("source"), F.lit("text").alias("description"), others.alias("other"), F.concat(F.lit("name "), F.col("first").cast("string")).alias("lead"),
    )
    names = m.groupBy("chunk_id").agg(F.collect_set("name").alias("all"))
    m = m.join(names, "chunk_id").withColumn("aliases", F.when(F.col("other"), F.array().cast("array<string>")).otherwise(F.array_remove("all", "")))
    out = K.merge_mentions(m.select("chunk_id", "document_id", "name", "type", "aliases", "confidence", "source", "description"), F.lower("name"))
    return out.select("chunk_id", F.col("mention_count"), F.round("confidence", 6).alias("confidence"), F.size("aliases").cast("long").alias("aliases"))


@query(r"""
WITH t AS (SELECT conv_id || '-' || turn AS chunk_id, text FROM conversations WHERE text IS NOT NULL)
SELECT chunk_id, n AS name, count(*) AS n FROM (SELECT chunk_id, lower(unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), '(?i)\b(test|error|power|current|command|failure|fault|bus)\b'))) AS n FROM t) GROUP BY ALL
UNION ALL SELECT 'p' || p_partkey, 'battery', 1 FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'p' || p_partkey, 'motor controller', 2 FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT 'p' || p_partkey, 'bus voltage', 1 FROM part WHERE p_partkey % 4 = 2""")
def gazetteer_mentions(spark, sf):
    """Terms of the gazetteer in turns and in sentences about parts: of overlapping terms the longest."""
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, F.lit("its battery is old")).when(k == 1, F.lit("Motor  controller, and motor controller again")).when(k == 2, F.lit("the bus voltage fell")).otherwise(F.lit("busy batteries"))
    parts = table(spark, sf, "part").select(F.concat(F.lit("p"), s("p_partkey")).alias("chunk_id"), F.lit("d").alias("document_id"), said.alias("content"))
    turns = table(spark, sf, "conversations").filter("text is not null").select(F.concat_ws("-", s("conv_id"), s("turn")).alias("chunk_id"), F.lit("d").alias("document_id"), F.col("text").alias("content"))
    m = E.gazetteer_mentions(parts.union(turns)).withColumn("name", F.regexp_replace(F.lower("name"), r"\s+", " "))
    return m.groupBy("chunk_id", "name").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- acronyms


def definitions(spark, sf):
    """Parts as sentences that define an acronym, in either form."""
    k = F.col("p_partkey")
    short = F.concat(F.lit("A"), F.element_at(F.split(F.lit("BX,CX,DX,EX,FX,GX,HX"), ","), (k % 7 + 1).cast("int")))
    long = F.concat(F.initcap("p_name"), F.lit(" device"))
    text = F.when(k % 2 == 0, F.concat(F.lit("We use. "), long, F.lit(" ("), short, F.lit(") here. Next."))).otherwise(F.concat(F.lit("Seen. "), short, F.lit(" ("), long, F.lit(") there. Next.")))
    return E.acronym_definitions(table(spark, sf, "part").select(s("p_partkey").alias("chunk_id"), text.alias("content")))


LONG = "list_reduce(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), lambda a, b: a || ' ' || b) || ' device'"
SHORT = "'A' || ['BX', 'CX', 'DX', 'EX', 'FX', 'GX', 'HX'][p_partkey % 7 + 1]"


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, {SHORT} AS acronym, CASE WHEN p_partkey % 2 = 0 THEN {LONG} ELSE {LONG} END AS expansion FROM part")
def acronym_definitions(spark, sf):
    return definitions(spark, sf).select("chunk_id", "acronym", "expansion")


@query(f"""
SELECT acronym, expansion, n, round(n / sum(n) OVER (PARTITION BY acronym), 6) AS share FROM (SELECT {SHORT} AS acronym, {LONG} AS expansion, count(*) AS n FROM part GROUP BY ALL)""")
def acronym_dictionary(spark, sf):
    return E.acronym_dictionary(definitions(spark, sf)).select("acronym", "expansion", "n", F.round("share", 6).alias("share"))


@query(f"""
WITH d AS (SELECT {SHORT} AS acronym, {LONG} AS expansion, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY acronym) AS share FROM d),
     b AS (SELECT acronym, expansion, share FROM r QUALIFY row_number() OVER (PARTITION BY acronym ORDER BY share DESC, expansion DESC) = 1)
SELECT n_nationkey AS id, 'NASA' AS acronym, 'National Aeronautics and Space Administration' AS expansion, 'override' AS method, CAST(0.95 AS DOUBLE) AS confidence FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_nationkey, acronym, expansion, 'dictionary', round(share, 6) FROM nation JOIN b ON n_nationkey % 2 = 1 AND acronym = 'A' || ['BX', 'CX', 'DX', 'EX', 'FX', 'GX', 'HX'][n_nationkey % 7 + 1]""")
def resolved_acronyms(spark, sf):
    """Without a context the most frequent expansion; a fixed one before all."""
    k = F.col("n_nationkey")
    short = F.concat(F.lit("A"), F.element_at(F.split(F.lit("BX,CX,DX,EX,FX,GX,HX"), ","), (k % 7 + 1).cast("int")))
    asked = table(spark, sf, "nation").select(k.alias("id"), F.when(k % 2 == 0, "NASA").otherwise(short).alias("acronym"), F.lit("").alias("context"))
    out = E.resolve_acronyms(asked, E.acronym_dictionary(definitions(spark, sf)), least=0.0)
    return out.select("id", "acronym", "expansion", "method", F.round("confidence", 6).alias("confidence"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, CASE WHEN p_partkey % 2 = 0 THEN ['old', 'the Bus Unit ' || p_partkey] ELSE ['old'] END AS aliases FROM part")
def expanded_aliases(spark, sf):
    k = F.col("p_partkey")
    m = table(spark, sf, "part").select(k.cast("string").alias("chunk_id"), F.concat(F.lit("the BU "), k.cast("string")).alias("name"), F.array(F.lit("old")).alias("aliases"))
    known = table(spark, sf, "part").filter("p_partkey % 2 = 0").select(k.cast("string").alias("chunk_id"), F.lit("BU").alias("acronym"), F.lit("Bus Unit").alias("expansion"))
    return E.expand_aliases(m, known).select("chunk_id", "aliases")


# ---------------------------------------------------------------- chunks


@query(r"""
WITH RECURSIVE d AS (SELECT CAST(doc_id AS VARCHAR) AS id, trim(text, ' ') AS t FROM documents WHERE length(trim(text, ' ')) >= 100 AND NOT regexp_matches(text, '\n\s*\n') AND NOT regexp_matches(text, '(^|\n)##? ')),
     w AS (SELECT id, t, CAST(floor(len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) * CAST(1.3 AS DOUBLE)) AS BIGINT) AS n FROM d),
     s AS (SELECT id, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: trim(x, ' ') <> '') AS ss FROM w WHERE n > 512),
     z AS (SELECT id, ss, list_transform(ss, lambda x: CAST(floor(len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> '')) * CAST(1.3 AS DOUBLE)) AS BIGINT)) AS ns FROM s),
     f(id, i, a, n, k, done_a, done_z, done_n) AS (
       SELECT id, 1, 1, ns[1], 0, 0, 0, CAST(0 AS BIGINT) FROM z
       UNION ALL
       SELECT f.id, f.i + 1, CASE WHEN full_ THEN greatest(f.a, f.i - 1) ELSE f.a END, CASE WHEN full_ THEN ns[f.i + 1] + ns[f.i] + CASE WHEN f.i - 1 >= f.a THEN ns[f.i - 1] ELSE 0 END ELSE f.n + ns[f.i + 1] END,
              f.k + CAST(full_ AS INTEGER), CASE WHEN full_ THEN f.a ELSE 0 END, CASE WHEN full_ THEN f.i ELSE 0 END, CASE WHEN full_ THEN f.n ELSE 0 END
       FROM (SELECT f.*, z.ns, f.n + z.ns[f.i + 1] > 512 AS full_ FROM f JOIN z ON z.id = f.id WHERE f.i < len(z.ns)) f),
     c AS (SELECT f.id, f.k, f.done_a AS a, f.done_z AS e, f.done_n AS n FROM f WHERE f.done_z > 0
           UNION ALL SELECT f.id, f.k + 1, f.a, f.i, f.n FROM f JOIN z ON z.id = f.id WHERE f.i = len(z.ns))
SELECT id AS document_id, '1' AS hierarchy_path, n AS token_count, md5(t) AS md5 FROM w WHERE n <= 512
UNION ALL SELECT c.id, '1.' || c.k, c.n, md5(array_to_string(ss[c.a:c.e], ' ')) FROM c JOIN z ON z.id = c.id""")
def sentence_chunks(spark, sf):
    """Level 4 chunks of documents of one paragraph: packed by sentences, two carried over."""
    from .text_queries import chunked

    one = table(spark, sf, "documents").filter(~F.col("text").rlike(r"\n\s*\n") & ~F.col("text").rlike(r"(^|\n)##? ")).select(F.col("doc_id").cast("string").alias("document_id"))
    return chunked(spark, sf).filter("level = 4").join(one, "document_id", "left_semi").select("document_id", "hierarchy_path", "token_count", F.md5("content").alias("md5"))


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS document_id, l_linenumber AS line, CAST(l_linenumber % 4 + 1 AS INTEGER) AS level
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) QUALIFY list_position([3, 2, 4, 1], l_linenumber % 4 + 1) = min(list_position([3, 2, 4, 1], l_linenumber % 4 + 1)) OVER (PARTITION BY l_orderkey)""")
def extraction_chunks(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return H.extraction_chunks(l.select(s("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") % 4 + 1).cast("int").alias("level")))


@query("""
SELECT count(*) AS total, count(*) FILTER (l_linenumber % 4 = 0) AS level_1, count(*) FILTER (l_linenumber % 4 = 1) AS level_2, count(*) FILTER (l_linenumber % 4 = 2) AS level_3, count(*) FILTER (l_linenumber % 4 = 3) AS level_4,
       round(avg(l_quantity), 4) AS avg_tokens, CAST(min(l_quantity) AS BIGINT) AS min_tokens, CAST(max(l_quantity) AS BIGINT) AS max_tokens, CAST(sum(l_quantity) AS BIGINT) AS total_tokens FROM lineitem""")
def chunk_stats(spark, sf):
    return H.chunk_statistics(table(spark, sf, "lineitem").select((F.col("l_linenumber") % 4 + 1).alias("level"), F.col("l_quantity").cast("long").alias("token_count")))


def markdown(spark, sf):
    """Orders as Markdown: text before a heading, sections and subsections."""
    k = s("o_orderkey")
    text = F.concat(F.lit("lost\n# First "), k, F.lit("\nbody  \nmore\n## Sub "), s("o_custkey"), F.lit("\ninner\n# Second\nend"))
    return table(spark, sf, "orders").select(k.alias("document_id"), text.alias("raw_text"), F.concat(F.lit("/in/"), k, F.lit(".md")).alias("file_path"))


@query(r"""
SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CAST(1 AS BIGINT) AS h1, CAST(0 AS BIGINT) AS h2, 'First ' || o_orderkey AS title, 'body' || chr(10) || 'more' AS content FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, 1, 'Sub ' || o_custkey, 'inner' FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 2, 0, 'Second', 'end' FROM orders""")
def markdown_sections(spark, sf):
    return H.sections(markdown(spark, sf))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS document_id, 'First ' || o_orderkey AS title FROM orders")
def inferred_titles(spark, sf):
    return markdown(spark, sf).select("document_id", H.infer_title(F.col("raw_text"), F.col("file_path")).alias("title"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS document_id, unnest([1, 2, 3, 2]) AS level, unnest(['', '1', '1.1', '2']) AS hierarchy_path FROM orders""")
def chunk_levels(spark, sf):
    return H.chunk_documents(markdown(spark, sf)).select("document_id", "level", "hierarchy_path")


# ---------------------------------------------------------------- text


@query("SELECT p_partkey, replace(p_name, 'the ', '') AS normalized, p_name AS display FROM part")
def normalize_names(spark, sf):
    said = F.concat(F.lit("  The  "), F.regexp_replace("p_name", " ", "   "), F.lit(" !"))
    return table(spark, sf, "part").select("p_partkey", X.normalize_name(said).alias("normalized"), X.display_name(said).alias("display"))


@query("SELECT p_partkey, lower(p_name) AS normalized FROM part")
def normalize_names_sql(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.normalize_ascii(F.concat(F.lit("A the "), F.initcap("p_name"), F.lit("?"))).alias("normalized"))


def noisy(spark, sf):
    k = s("o_orderkey")
    text = F.concat(F.lit("Page 3 of 9 of x\nCONFIDENTIAL notes\nFirst "), k, F.lit("  line\n\n\n\n  "), k, F.lit("  \n-----\n....\n12\nCopyright ACME 2020\n\tLast "), s("o_custkey"), F.lit(" DRAFT word\n"))
    return table(spark, sf, "orders").select("o_orderkey", text.alias("text"))


@query()
def clean_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", X.clean("text").alias("c"))
    return d.select("doc_id", F.md5("c").alias("md5"), *X.cleaning_stats(F.col("text"), F.col("c")))


@query("SELECT o_orderkey, list_filter(['First ' || o_orderkey || ' line', 'Last ' || o_custkey || ' word'], lambda x: true) AS lines FROM orders")
def cleaned_lines(spark, sf):
    """Headers, watermarks, page numbers, noise and footers go; what is said stays."""
    c = F.split(X.clean("text"), "\n")
    return noisy(spark, sf).select("o_orderkey", F.filter(F.transform(c, lambda x: F.regexp_replace(F.trim(x), " +", " ")), lambda x: x.rlike("^(First|Last)")).alias("lines"))


@query("SELECT p_partkey, 'sees ' || p_name || ' now' AS window, p_name AS sentence FROM part")
def contexts(spark, sf):
    """Some characters around a place, and the sentence around it."""
    text = F.concat(F.lit("It sees "), F.col("p_name"), F.lit(" now"))
    said = F.concat(F.lit("Before. "), F.col("p_name"), F.lit("; after"))
    z = F.char_length("p_name")
    return table(spark, sf, "part").select("p_partkey", X.context_window(text, F.lit(8), 8 + z, 5).alias("window"), X.sentence_context(said, F.lit(8), 8 + z).alias("sentence"))


@query("SELECT p_partkey, p_name AS expansion, len(p_name) AS n, repeat('#', greatest(1, CAST(round(p_size / 50.0 * 20) AS INTEGER))) AS bar FROM part")
def expansions_and_bars(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.clean_expansion(F.concat(F.lit(" The  "), F.regexp_replace("p_name", " ", "  "), F.lit(" -;"))).alias("expansion"), F.char_length("p_name").cast("long").alias("n"), X.ascii_bar(F.col("p_size"), F.lit(50)).alias("bar"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'numbers' WHEN 2 THEN 'acronyms' WHEN 3 THEN 'length' END AS lost FROM part""")
def rewrite_checks(spark, sf):
    """A rewrite must keep numbers, acronyms and most of a long text."""
    k = F.col("p_partkey") % 4
    old = F.concat(F.lit("Unit 42 of the ABC has "), F.when(k == 3, F.repeat(F.lit("many words "), F.lit(60))).otherwise(F.col("p_name")))
    new = F.when(k == 0, old).when(k == 1, F.lit("Unit of the ABC has")).when(k == 2, F.lit("Unit 42 of it has")).otherwise(F.lit("Unit 42 ABC"))
    return table(spark, sf, "part").select("p_partkey", X.preserved(old, new).alias("lost"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 200 THEN md5(text) ELSE md5(regexp_replace(left(text, 200), '\s+\S*$', '') || '...') END AS md5 FROM documents")
def truncated_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.truncate_words(F.col("text"), 50)).alias("md5"))


@query(r"SELECT doc_id, CAST(len(regexp_split_to_array(text, '\n\s*\n')) AS BIGINT) AS paragraphs FROM documents")
def paragraph_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.paragraphs(F.col("text"))).cast("long").alias("paragraphs"))


@query("SELECT a.p_partkey AS l, b.p_partkey AS r, CAST(least(0.99, CASE WHEN least(length(a.p_name), length(b.p_name)) < 4 THEN 0.96 WHEN least(length(a.p_name), length(b.p_name)) < 8 THEN 0.92 ELSE 0.9 END) AS DOUBLE) AS threshold, CAST(greatest(0, 0.95 - 0.25 * least(0.4, abs(length(a.p_name) - length(b.p_name)) / greatest(length(a.p_name), length(b.p_name), 1)) + 0.05) AS DOUBLE) AS raw FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def fuzzy_thresholds(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("l"), F.col("p_name").alias("ln"))
    b = a.select((F.col("l") - 1).alias("l"), F.col("l").alias("r"), F.col("ln").alias("rn"))
    return a.join(b, "l").select("l", "r", S.fuzzy_threshold(F.col("ln"), F.col("rn")).alias("threshold"), S.fuzzy_confidence(F.lit(0.95), F.lit(0.9), F.col("ln"), F.col("rn")).alias("raw"))


@query("""
SELECT a.n_nationkey AS l, b.n_nationkey AS r, round(1.0 - (length(a.n_name) + length(b.n_name) - 2 * (7 + CASE WHEN length(a.n_name) = length(b.n_name) THEN CAST(a.n_name[8] = b.n_name[8] AS INTEGER) + CAST(length(a.n_name) > 8 AND a.n_name[9] = b.n_name[9] AS INTEGER)
       + CASE WHEN length(a.n_name) = 9 AND a.n_name[8] <> b.n_name[8] AND a.n_name[9] <> b.n_name[9] AND (a.n_name[8] = b.n_name[9] OR a.n_name[9] = b.n_name[8]) THEN 1 ELSE 0 END
       ELSE CAST(contains(CASE WHEN length(a.n_name) > length(b.n_name) THEN a.n_name[8:9] ELSE b.n_name[8:9] END, CASE WHEN length(a.n_name) > length(b.n_name) THEN b.n_name[8] ELSE a.n_name[8] END) AS INTEGER) END)) / (length(a.n_name) + length(b.n_name)), 6) AS ratio
FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey""")
def string_ratio(spark, sf):
    """Nations' names share their first seven letters, so the ratio follows from one or two digits."""
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("l"), F.col("n_name").alias("ln")), n.select(F.col("n_nationkey").alias("r"), F.col("n_name").alias("rn"))
    return a.join(b, F.col("l") < F.col("r")).select("l", "r", F.round(S.fuzzy_ratio("ln", "rn"), 6).alias("ratio"))


# ---------------------------------------------------------------- questions


def asked(spark, sf):
    """Nations as questions of five kinds."""
    k = F.col("n_nationkey")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("What is the power system in the bay with value greater than "), k.cast("string"), F.lit("?")))
        .when(k % 5 == 1, F.concat(F.lit("Which components contain Unit "), k.cast("string"), F.lit(" within "), (k % 4 + 1).cast("string"), F.lit(" levels")))
        .when(k % 5 == 2, F.lit("How to perform the startup procedure from document manual"))
        .when(k % 5 == 3, F.lit("compare the impact of every failure on page 7 and trace the history of commands that precede it in detail please")).otherwise(F.lit("NASA"))
    )
    return table(spark, sf, "nation").select(k.alias("query_id"), text.alias("text"))


@query("""
SELECT n_nationkey AS query_id, unnest(['content', 'confidence_score']) AS field, unnest(['contains', 'gt']) AS operator, unnest(['bay', CAST(n_nationkey AS VARCHAR)]) AS value FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT n_nationkey, unnest(['document_id', 'document_id']), unnest(['source', 'document']), unnest(['document', 'manual']) FROM nation WHERE n_nationkey % 5 = 2
UNION ALL SELECT n_nationkey, unnest(['page_number', 'content']), unnest(['page', 'contains']), unnest(['7', 'detail']) FROM nation WHERE n_nationkey % 5 = 3""")
def constraints(spark, sf):
    return asked(spark, sf).select("query_id", F.explode(Q.constraints(X.normalize_query(F.col("text")))).alias("c")).select("query_id", "c.field", "c.operator", "c.value")


@query("""
SELECT n_nationkey AS query_id, CASE n_nationkey % 5 WHEN 0 THEN 'semantic' WHEN 1 THEN 'structural' WHEN 2 THEN 'procedural' ELSE 'semantic' END AS intent,
       CASE n_nationkey % 5 WHEN 0 THEN 'hybrid_parallel' WHEN 1 THEN 'graph_first' WHEN 2 THEN 'graph_first' WHEN 3 THEN 'hybrid_parallel' ELSE 'hybrid_parallel' END AS strategy, 
       CASE n_nationkey % 5 WHEN 1 THEN n_nationkey % 4 + 1 ELSE 3 END AS max_depth, n_nationkey % 5 IN (1, 3) OR n_nationkey % 5 = 0 AS graph, n_nationkey % 5 IN (2, 3) AS complex, CASE WHEN n_nationkey % 5 = 4 THEN 'too short' END AS problem FROM nation""")
def parsed_questions(spark, sf):
    p = Q.parse(asked(spark, sf))
    return p.select("query_id", "intent", "strategy", "max_depth", F.col("requires_graph_traversal").alias("graph"), F.col("is_complex").alias("complex"), "problem")


@query("""
SELECT n_nationkey AS query_id, unnest(['power', 'system']) AS term, unnest([['electrical', 'energy'], ['subsystem', 'module', 'unit']]) AS synonyms FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT n_nationkey, 'procedure', ['process', 'operation', 'workflow'] FROM nation WHERE n_nationkey % 5 = 2 UNION ALL SELECT n_nationkey, 'failure', ['anomaly', 'issue', 'problem'] FROM nation WHERE n_nationkey % 5 = 3""")
def expanded_terms(spark, sf):
    return asked(spark, sf).select("query_id", F.explode(Q.expansions(F.col("text"))).alias("term", "synonyms"))


@query("SELECT n_nationkey AS query_id, CASE WHEN n_nationkey % 5 = 4 THEN 'NASA (National Aeronautics and Space Administration)' WHEN n_nationkey % 5 = 2 THEN 'How to perform the startup procedure from document manual (operation, process, workflow)' END AS text FROM nation WHERE n_nationkey % 5 IN (2, 4)")
def enriched_questions(spark, sf):
    t = F.col("text")
    known = {a: (long,) for a, long in C.ACRONYM_OVERRIDES.items()}
    return asked(spark, sf).filter("query_id % 5 in (2, 4)").select("query_id", Q.enriched(t, Q.expansions(t), Q.acronym_expansions(t, known)).alias("text"))


@query("SELECT n_nationkey AS query_id, CASE n_nationkey % 5 WHEN 0 THEN 'Power' WHEN 2 THEN 'startup' END AS topic FROM nation")
def question_topics(spark, sf):
    return asked(spark, sf).select("query_id", Q.topic(F.col("text"), ["Power", "startup", "thermal"]).alias("topic"))


@query("SELECT n_nationkey AS query_id, 'query_20240102030405_' || left(md5(n_name), 12) AS id FROM nation")
def question_ids(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), Q.query_id(F.col("n_name"), F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("id"))


# ---------------------------------------------------------------- results


def answers(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    return l.select(F.col("l_orderkey").alias("query_id"), s("p").alias("chunk_id"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("text "), s("p")).alias("content"))


@query("""
SELECT l_orderkey AS query_id, string_agg('[' || l_linenumber || '] text ' || p, chr(10) || chr(10) ORDER BY l_linenumber) AS context FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL) WHERE l_linenumber <= 5 GROUP BY l_orderkey""")
def prompt_context(spark, sf):
    return R.prompt_context(answers(spark, sf))


@query("SELECT n_nationkey AS query_id, [1, CAST(2 + n_nationkey % 3 AS INTEGER)] AS cited FROM nation")
def citations(spark, sf):
    text = F.concat(F.lit("as [1] and ["), (2 + F.col("n_nationkey") % 3).cast("string"), F.lit("] say, not [9]"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), R.cited(text, F.lit(5)).alias("cited"))


@query("""
SELECT l_orderkey AS query_id, CAST(p AS VARCHAR) AS chunk_id, l_linenumber AS rank FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY l_orderkey, p ORDER BY l_linenumber % 2, l_linenumber) = 1""")
def distinct_results(spark, sf):
    return R.distinct_chunks(answers(spark, sf).withColumn("step", F.col("rank") % 2)).select("query_id", "chunk_id", "rank")


@query("""
WITH a AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS p FROM lineitem)
SELECT DISTINCT query_id, 'document' AS kind, p_brand AS id FROM a JOIN part ON p = p_partkey UNION SELECT DISTINCT query_id, 'entity', 'e' || p_size FROM a JOIN part ON p = p_partkey""")
def result_ids(spark, sf):
    hits = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), s("l_partkey").alias("chunk_id"))
    of = table(spark, sf, "part").select(s("p_partkey").alias("chunk_id"), F.col("p_brand").alias("document_id"), F.array(F.concat(F.lit("e"), s("p_size"))).alias("entity_ids"))
    return R.result_ids(hits, of)
