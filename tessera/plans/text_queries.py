"""Text functions, chunking and question understanding over `documents` and `conversations`."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..functions import query as Q
from ..functions import text as X
from ..operators import candidates as K
from ..operators import chunking as H
from ..operators import extraction as E
from ..operators import search as B
from .registry import query, table


def docs(spark, sf):
    return table(spark, sf, "documents")


def turns(spark, sf):
    return table(spark, sf, "conversations")


WORDS = r"len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> ''))"


@query(f"SELECT doc_id, CAST({WORDS} AS BIGINT) AS words, CAST(floor({WORDS} * CAST(1.3 AS DOUBLE)) AS BIGINT) AS tokens FROM documents")
def token_count(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return docs(spark, sf).select("doc_id", X.word_count(t).cast("long").alias("words"), X.token_estimate(t).alias("tokens"))


@query(r"""
SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, md5(s[1]) AS first FROM
  (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)) AS s FROM documents)""")
def sentence_split(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("sentences"), F.md5(F.get(X.sentences(F.col("text")), F.lit(0))).alias("first"))


@query(r"SELECT doc_id, md5(trim(t6, ' ' || chr(10))) AS md5 FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '(?m) +$', '', 'g'), '(?m)^\s+$', '', 'g'), '[\t\r\f\v]', ' ', 'g') AS t6 FROM documents)")
def whitespace_normalize(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.normalize_whitespace(F.col("text"))).alias("md5"))


def _cleaning_sql() -> str:
    """The removal chain and the white-space steps as nested replacements."""
    out = "text"
    steps = [(p.replace("(?i)", "(?mi)") if p.startswith("(?i)") else "(?m)" + p, "''") for category in C.CLEANING.values() for p in category]
    steps += [(" {2,}", "' '"), (r"\n{3,}", "chr(10) || chr(10)"), ("(?m) +$", "''"), (r"(?m)^\s+$", "''"), (r"[\t\r\f\v]", "' '"), (r"^\s+|\s+$", "''")]
    for pattern, new in steps:
        out = f"regexp_replace({out}, '{re.sub(r'(?<![\\])[.](?=[*])', '[^' + chr(92) + 'n]', pattern)}', {new}, 'g')"
    return out


@query(f"SELECT doc_id, md5(c) AS md5, length(c) AS n FROM (SELECT doc_id, {_cleaning_sql()} AS c FROM documents)")
def clean_text_sql(spark, sf):
    c = X.clean_sql(F.col("text"))
    return docs(spark, sf).select("doc_id", F.md5(c).alias("md5"), F.char_length(c).cast("long").alias("n"))


@query("SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(p_name, '[^a-zA-Z0-9]+', '_', 'g')), '^_+|_+$', '', 'g')) AS fragment FROM part")
def key_fragment(spark, sf):
    return table(spark, sf, "part").select("p_partkey", schemas.key_fragment(F.col("p_name")).alias("fragment"))


@query("SELECT c_custkey, regexp_replace(c_name, '[^a-zA-Z0-9]+', '_', 'g') AS slug FROM customer")
def slug(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.slug(F.col("c_name")).alias("slug"))


@query(r"""
WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS ws FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.ws) = 0 OR len(b.ws) = 0 THEN 0
       ELSE len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) END, 6) AS jaccard
FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def content_similarity(spark, sf):
    w = turns(spark, sf).select("conv_id", "turn", X.word_set(F.coalesce("text", F.lit(""))).alias("ws"))
    b = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ws").alias("next"))
    return w.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.jaccard(F.col("ws"), F.col("next")), 6).alias("jaccard"))


def chunked(spark, sf):
    d = docs(spark, sf).select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("raw_text"), F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"))
    return H.chunk_documents(d)


@query(rf"""
SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(i AS VARCHAR) AS hierarchy_path, md5(t) AS md5, CAST(floor({WORDS.replace('coalesce(text', 'coalesce(t')} * CAST(1.3 AS DOUBLE)) AS BIGINT) AS token_count
FROM (SELECT doc_id, i, trim(p[i], ' ') AS t FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '
\s*
') AS p FROM documents)))
WHERE length(t) >= 100""")
def paragraph_filter(spark, sf):
    """Paragraphs of at least 100 characters, each a chunk whatever its length."""
    d = docs(spark, sf).select(F.col("doc_id").cast("string").alias("document_id"), F.lit("root").alias("chunk_id"), F.lit("").alias("hierarchy_path"), F.lit("").alias("section_title"), F.col("text").alias("content"))
    return H.paragraph_chunks(d, max_tokens=1 << 40).select("document_id", "hierarchy_path", F.md5("content").alias("md5"), "token_count")


@query("SELECT sha256(coalesce(text, '')) AS checksum, count(*) AS n, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def checksum_dedup(spark, sf):
    return K.duplicate_checksums(docs(spark, sf), F.sha2(F.coalesce("text", F.lit("")), 256), "doc_id")


@query(rf"SELECT CAST(doc_id AS VARCHAR) AS chunk_id, t AS acronym, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), '{C.ACRONYM}')) AS t FROM documents) WHERE regexp_matches(t, '[A-Z]') GROUP BY ALL")
def acronym_tokens(spark, sf):
    return E.acronym_tokens(as_chunks(spark, sf))


def as_chunks(spark, sf):
    return docs(spark, sf).select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("document_id"), F.col("text").alias("content"))


def _hits_sql(family: str) -> str:
    return " + ".join(f"CAST(regexp_matches(q, '(?i){p}') AS INTEGER)" for p in C.INTENT_PATTERNS[family])


NORMALIZED = r"regexp_replace(regexp_replace(trim(coalesce(text, ''), ' '), '\s+', ' ', 'g'), '\?$', '')"
INTENT_SQL = f"""
SELECT conv_id, turn, CASE WHEN f >= 2 THEN 'hybrid' WHEN a > 0 THEN 'semantic' WHEN b > 0 THEN 'structural' WHEN c > 0 THEN 'procedural'
            WHEN regexp_matches(q, '(?i)^\\s*how\\s+to\\b') THEN 'procedural' ELSE 'semantic' END AS intent,
       CASE WHEN f >= 2 THEN 0.8 WHEN f = 1 THEN 0.9 WHEN lower(regexp_extract(q, '^\\s*(\\w+)', 1)) IN ('what', 'who', 'how') THEN 0.7 ELSE 0.5 END AS confidence, q
FROM (SELECT *, CAST(a > 0 AS INTEGER) + CAST(b > 0 AS INTEGER) + CAST(c > 0 AS INTEGER) AS f FROM
  (SELECT conv_id, turn, q, {_hits_sql('semantic')} AS a, {_hits_sql('structural')} AS b, {_hits_sql('procedural')} AS c
   FROM (SELECT conv_id, turn, {NORMALIZED} AS q FROM conversations)))"""


@query(f"SELECT conv_id, turn, intent, confidence FROM ({INTENT_SQL})")
def intent_classify(spark, sf):
    q = X.normalize_query(F.coalesce("text", F.lit("")))
    return turns(spark, sf).select("conv_id", "turn", Q.intent(q).alias("i")).select("conv_id", "turn", "i.intent", "i.confidence")


_KEYWORDS = ", ".join(f"CASE WHEN contains(q, '{k}') THEN '{v}' END" for k, v in C.RELATIONSHIP_KEYWORDS.items())


@query(f"""
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter([{_KEYWORDS}], lambda x: x IS NOT NULL))), ',') AS types
FROM (SELECT conv_id, turn, lower({NORMALIZED}) AS q FROM conversations)""")
def relationship_keywords(spark, sf):
    q = X.normalize_query(F.coalesce("text", F.lit("")))
    return turns(spark, sf).select("conv_id", "turn", F.array_join(F.array_sort(Q.relationship_types(q)), ",").alias("types"))


@query(f"""
SELECT conv_id, turn, coalesce(TRY_CAST(regexp_extract(q, '(?i)\\b(\\d+)\\s*(?:levels?|hops?|degrees?)\\b', 1) AS INTEGER),
       CASE WHEN regexp_matches(lower(q), 'direct|immediate|first') THEN 1 ELSE 3 END) AS depth
FROM (SELECT conv_id, turn, {NORMALIZED} AS q FROM conversations)""")
def traversal_depth(spark, sf):
    q = X.normalize_query(F.coalesce("text", F.lit("")))
    return turns(spark, sf).select("conv_id", "turn", Q.max_depth(q).alias("depth"))


_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


@query(f"""
WITH ix AS (SELECT doc_id AS id, unnest({_TOKENS}) AS token FROM documents),
     tf AS (SELECT id, token, count(*) AS tf FROM ix GROUP BY ALL),
     ln AS (SELECT doc_id AS id, len({_TOKENS}) AS l FROM documents),
     st AS (SELECT count(*) AS n, avg(l) AS a FROM ln),
     q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS token FROM benchmark WHERE item_id % 50 = 0),
     df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
     sc AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / a))) AS s
            FROM q JOIN tf USING (token) JOIN df USING (token) JOIN ln USING (id), st GROUP BY ALL)
SELECT query_id, id, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 8) DESC, id) AS n FROM sc) WHERE n <= 10""")
def fulltext_bm25(spark, sf):
    from pyspark.sql import Window as W

    d, t = docs(spark, sf), F.coalesce("text", F.lit(""))
    asked = table(spark, sf, "benchmark").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")
    found = B.bm25(B.index(d, "doc_id", t), B.lengths(d, "doc_id", t), asked)
    n = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 8)), "id"))
    return found.withColumn("n", n).filter("n <= 10").select("query_id", "id", F.round("score", 4).alias("score"))
