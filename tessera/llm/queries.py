"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, language_id, licenses, packing, pii, repeats, secrets, simhash, toxicity
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = language_id.held_out("doc_id", 4, 2)
    model = toxicity.train(docs, labels.filter(~out))
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a tree of files: source / ten thousands / hundreds / document; round numbers are the licence files."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    folder = F.when(k % 10000 == 0, F.array(F.floor(k / 10000).cast("string"))).otherwise(
        F.array(F.floor(k / 10000).cast("string"), F.floor(k / 100).cast("string"))
    )
    name = F.when(k % 100 == 0, F.concat(F.lit("LICENSE-"), k.cast("string"))).otherwise(F.concat(k.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), folder, name)
    return licenses.find_licenses(docs.select(path.alias("path"), "text"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out("doc_id", 5, 0)
    model = language_id.train(docs.filter(~out))
    found = language_id.identify(docs, model)
    return found.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_decontaminate, op3_packing, op4_exact_dedup, op5_repeats, op6_personal_data, op7_licenses, op8_secrets, op9_simhash, op10_language_id)}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
     i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
     iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[b:b + n - 1], ' ') AS w
            FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS b
                  FROM i WHERE len(ws) > 0)),
     dw AS (SELECT doc_id, n, b, array_to_string(ws[b:b + n - 1], ' ') AS w
            FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS b
                  FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
     hit AS (SELECT doc_id, b, dw.n, item_id FROM dw JOIN iw ON dw.w = iw.w AND dw.n = iw.n),
     pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
             FROM (SELECT DISTINCT doc_id, unnest(range(b, b + n)) AS p FROM hit) GROUP BY doc_id),
     its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS list
             FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP4_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


_TEMPLATES = ", ".join("('{}', {}, '{}')".format(k, i, t.replace("'", "''")) for k, texts in licenses.TEMPLATES.items() for i, t in enumerate(texts))

OP7_SQL = rf"""
WITH f AS (SELECT concat_ws('/', coalesce(source, 'none'), CAST(doc_id // 10000 AS VARCHAR),
                            CASE WHEN doc_id % 10000 <> 0 THEN CAST(doc_id // 100 AS VARCHAR) END,
                            CASE WHEN doc_id % 100 = 0 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END) AS path,
                  coalesce(text, '') AS t FROM documents),
     tpl(name, v, t) AS (VALUES {_TEMPLATES}),
     terms AS (SELECT name, v, token, count(*) AS tf FROM (SELECT name, v, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS token FROM tpl)
               GROUP BY ALL),
     n AS (SELECT count(*) AS n FROM f),
     df AS (SELECT token, count(*) AS c FROM (SELECT DISTINCT path, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS token FROM f)
            WHERE token IN (SELECT token FROM terms) GROUP BY token),
     idf AS (SELECT DISTINCT token, ln((1.0 + n) / (1.0 + coalesce(c, 0))) + 1.0 AS idf FROM terms LEFT JOIN df USING (token), n),
     w AS (SELECT name, v, token, tf * idf AS w FROM terms JOIN idf USING (token)),
     norm AS (SELECT name, v, sqrt(sum(w * w)) AS norm FROM w GROUP BY name, v),
     parts AS (SELECT path, list_concat(string_split(t, chr(10)), list_filter(regexp_split_to_array(t, '{licenses.BARE_LINES}'), lambda x: contains(x, chr(10))),
                                        list_filter(regexp_split_to_array(t, '{licenses.EMPTY_LINES}'), lambda x: regexp_matches(x, '{licenses.BARE_LINES}')),
                                        CASE WHEN regexp_matches(path, '(^|/)LICENSE-[^/]*$') THEN [t] ELSE [] END) AS ls FROM f),
     lines AS (SELECT path, i, regexp_extract_all(lower(ls[i]), '[a-z0-9]+') AS ws FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM parts)),
     lt AS (SELECT path, i, token, count(*) AS c FROM (SELECT path, i, unnest(ws) AS token FROM lines) GROUP BY ALL),
     lx AS (SELECT path, i, token, c * coalesce(idf, (SELECT ln(1.0 + n) + 1.0 FROM n)) AS x FROM lt LEFT JOIN idf USING (token)),
     len AS (SELECT path, i, sqrt(sum(x * x)) AS length FROM lx GROUP BY ALL),
     dot AS (SELECT path, i, name, v, sum(x * w / norm) AS dot FROM lx JOIN w USING (token) JOIN norm USING (name, v) GROUP BY ALL),
     cosine AS (SELECT path, name, round(dot / length, 6) AS score FROM dot JOIN len USING (path, i)),
     own AS (SELECT path, name AS license, score FROM cosine WHERE score >= 0.8
             QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, name) = 1),
     mine AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS dir, license, score FROM f LEFT JOIN own USING (path)),
     granted AS (SELECT dir AS up, path AS gp, license AS gl, score AS gs FROM mine WHERE license IS NOT NULL AND regexp_matches(path, '(^|/)LICENSE-[^/]*$')
                 QUALIFY row_number() OVER (PARTITION BY dir ORDER BY path) = 1),
     inherited AS (SELECT path, gp, gl, gs FROM mine JOIN granted ON up = '' OR dir = up OR starts_with(dir, up || '/')
                   WHERE license IS NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(up) DESC) = 1)
SELECT path, coalesce(license, gl) AS license, coalesce(score, gs) AS score,
       CASE WHEN license IS NOT NULL THEN 'own' WHEN gl IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN license IS NOT NULL THEN path ELSE gp END AS source_path
FROM mine LEFT JOIN inherited USING (path)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op7_licenses": OP7_SQL}
