"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along paths.

DataFrame functions only. A text is compared by its lines, its paragraphs (lines between
lines without a word, as in a comment), its blocks (paragraphs between empty lines, as a
whole header) and, if its name is that of a licence file, as a whole. Document frequencies
of the templates' words are counted over all texts; a word no template has weighs as one
that was never seen. A part can reach the threshold with a template only if it has one
of the template's prefix words: the heaviest ones, until the rest of the vector is shorter
than the threshold. Only such texts are split into parts. Parts of equal words are scored
once, whatever their number, and only those whose templates' words make up the threshold's
share of their length meet the templates.

A licence file (by its name) speaks for its directory. A file without a licence of its own
inherits from the nearest directory above that has one. That is settled once per directory,
so files meet their directory's answer in one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash
from .license_texts import TEMPLATES

LICENSE_NAME = r"(?i)^(?:licen[cs]e|copying|notice|unlicense)(?:[._-].*)?$"
NOT_WORD = r"[^a-z0-9]+"
#: What lies between paragraphs, and between blocks.
BARE_LINES = r"\n(?:[^A-Za-z0-9\n]*\n)+"
EMPTY_LINES = r"\n(?:[ \t\r\f\x0B]*\n)+"
BROADCAST_TERMS = 100_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD, -1), lambda w: w != "")


def parts(text: Column, whole: Column) -> Column:
    """Lines, paragraphs and blocks of several lines, and the text itself where `whole` holds."""
    some = lambda cut, has: F.filter(F.split(text, cut, -1), lambda x: x.rlike(has))
    nothing = F.array().cast("array<string>")
    return F.concat(F.split(text, "\n", -1), some(BARE_LINES, r"\n"), some(EMPTY_LINES, BARE_LINES), F.when(whole, F.array(text)).otherwise(nothing))


def template_table(spark: SparkSession, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """name, v (number of the text), token, tf; the templates are a fixed list of the caller's, so they may be literals of the plan."""
    rows = [F.struct(F.lit(k).alias("name"), F.lit(i).alias("v"), F.lit(t).alias("t")) for k, texts in templates.items() for i, t in enumerate(texts)]
    each = spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.name", "x.v", F.explode(_words(F.col("x.t"))).alias("token"))
    return each.groupBy("name", "v", "token").agg(F.count(F.lit(1)).alias("tf"))


def directory(path: Column) -> Column:
    """The folder of a path; '' for the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def find_licenses(
    files: DataFrame,
    path_col: str = "path",
    text_col: str = "text",
    templates: dict[str, tuple[str, ...]] | None = None,
    threshold: float = 0.8,
) -> DataFrame:
    """One row per input row: path, license, score, origin ('own', 'inherited', 'none'), source_path.

    templates: several texts for each licence; by default those of license_texts.
    Of equal scores the template first by name wins; of several licence files in one
    directory the one first by path. Null text has no licence of its own, a null path none
    to inherit. Rows that repeat a path are told apart by their texts. Empty input gives no
    rows. Other columns are ignored, whatever their names.
    """
    spark = files.sparkSession
    own = files.select(F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    own = own.withColumn("th", F.xxhash64("t"))
    terms = template_table(spark, templates or TEMPLATES)
    vocabulary = sorted(r[0] for r in terms.select("token").distinct().collect())  # of the fixed templates
    in_text = F.array_intersect(F.split(F.lower("t"), NOT_WORD), F.array(*map(F.lit, vocabulary)))
    counted = own.select(F.explode(F.concat(in_text, F.array(F.lit("")))).alias("token")).groupBy("token").count()  # '' counts the texts
    counted = stash(counted, "license-df")
    n = counted.filter("token = ''").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    idf = F.log((1.0 + F.col("n")) / (1.0 + F.coalesce("count", F.lit(0)))) + 1.0
    rated = terms.join(counted, "token", "left").crossJoin(F.broadcast(n)).select("name", "v", "token", "tf", idf.alias("idf"), (F.log(1.0 + F.col("n")) + 1.0).alias("unseen"))
    rated = rated.withColumn("w", F.col("tf") * F.col("idf"))
    rated = rated.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("name", "v"))))
    rest = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("name", "v").orderBy("w", F.desc("token")).rowsBetween(W.unboundedPreceding, 0)))
    rated = stash(rated.withColumn("prefix", rest >= threshold), "license-terms")
    prefix = F.array(*[F.lit(r[0]) for r in rated.filter("prefix").select("token").distinct().orderBy("token").collect()])
    unseen = rated.select("unseen").limit(1)
    few = rated.count() <= BROADCAST_TERMS
    small = F.broadcast if few else (lambda df: df)
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    some = own.filter(F.arrays_overlap(F.split(F.lower("t"), NOT_WORD), prefix))
    units = some.select("path", "th", F.explode(parts(F.col("t"), F.coalesce(base.rlike(LICENSE_NAME), F.lit(False)))).alias("text"))
    units = units.select("path", "th", _words(F.col("text")).alias("ws")).filter(F.arrays_overlap("ws", prefix))
    units = stash(units.withColumn("part", F.unhex(F.sha2(F.array_join("ws", " "), 256))), "license-parts")
    # '' counts the copies of a part; its words are counted over all of them, and divided by them
    words = units.select("part", F.explode(F.concat("ws", F.array(F.lit("")))).alias("token")).groupBy("part", "token").agg(F.count(F.lit(1)).alias("n"))
    weights = rated.select("token", "idf").distinct()
    words = words.join(small(weights), "token", "left").crossJoin(F.broadcast(unseen))
    words = words.withColumn("x", F.when(F.col("token") != "", F.col("n") * F.coalesce("idf", "unseen")))
    squares = lambda x: F.coalesce(F.sum(x * x), F.lit(0.0))
    known = F.when(F.col("idf").isNotNull(), F.col("x"))
    each = words.groupBy("part").agg(
        F.max(F.when(F.col("token") == "", F.col("n"))).alias("copies"),
        squares(F.col("x")).alias("all"),
        squares(known).alias("known"),
        F.collect_list(F.when(known.isNotNull(), F.struct("token", "x"))).alias("xs"),
    )
    near = each.filter(F.col("known") >= max(threshold - 1e-6, 0.0) ** 2 * F.col("all"))
    near = near.select("part", "copies", (F.sqrt("all") / F.col("copies")).alias("length"), F.explode("xs").alias("e"))
    near = near.select("part", "length", "e.token", (F.col("e.x") / F.col("copies")).alias("x"))
    dots = near.join(small(rated.select("name", "v", "token", "w")), "token").groupBy("part", "name", "v").agg(F.sum(F.col("x") * F.col("w")).alias("dot"), F.max("length").alias("length"))
    cosine = dots.select("part", "name", F.round(F.col("dot") / F.col("length"), 6).alias("score")).filter(F.col("score") >= threshold)
    first = cosine.groupBy("part").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b"))
    best = units.select("path", "th", "part").join(first, "part").groupBy("path", "th").agg(F.min("b").alias("b"))
    best = best.select(F.col("path").alias("p2"), F.col("th").alias("th2"), F.col("b.name").alias("license"), (-F.col("b.s")).alias("score"))
    mine = own.select("path", "th").join(best, F.col("path").eqNullSafe(F.col("p2")) & (F.col("th") == F.col("th2")), "left")
    mine = stash(mine.select("path", directory(F.col("path")).alias("dir"), "license", "score"), "license-own")
    granted = mine.filter(F.col("license").isNotNull() & base.rlike(LICENSE_NAME)).groupBy("dir").agg(F.min(F.struct("path", "license", "score")).alias("g"))
    above = mine.filter("license is null and dir is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = above.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).alias("up"))
    near = above.distinct().join(granted.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by("g", F.length("up")).alias("g"))
    return mine.join(near.withColumnRenamed("dir", "d2"), (F.col("dir") == F.col("d2")) & F.col("license").isNull(), "left").select(
        "path",
        F.coalesce("license", "g.license").alias("license"),
        F.coalesce("score", "g.score").alias("score"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("g").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("g.path")).alias("source_path"),
    )
