"""Benchmark decontamination as a prefix-filtered containment join of word shingles.

An item's windows are its runs of `window` words (an item with fewer words is one window).
A window, as a sequence of `shingle`-word shingles, lies in a document only if all its
shingles do, so any one of them is a sufficient prefix: shingles are ordered by their count
in the documents and the rarest is joined. Length and position of the match bound where the
window can start; the words there are then compared one by one, so no hash decides.

Everything is DataFrame functions: the documents' shingles are hashed inside the generated
code of one scan and meet the item side without a shuffle while that side is small. Its size
is counted first; beyond `broadcast_rows` the join is an ordinary shuffled one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stash, unused

#: What lies between words: everything ASCII but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """Words of a text, lower-cased A-Z; none for null."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, -1)
    # Only the first and the last part can be empty, as a separator takes all it can.
    return F.transform(
        F.array(parts),
        lambda p: F.slice(
            p,
            F.when(F.get(p, F.lit(0)) == "", 2).otherwise(1),
            F.greatest(F.lit(0), F.size(p) - (F.get(p, F.lit(0)) == "").cast("int") - (F.element_at(p, -1) == "").cast("int")),
        ),
    )[0]


def shingle_hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(k)])


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """w (its words), len, item of every window of every item, once each."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    size = F.least(F.size("ws"), F.lit(window))
    each = words.select("item", "ws", size.alias("len"), F.explode(F.sequence(F.lit(1), F.size("ws") - size + 1)).alias("at"))
    return each.select("item", "len", F.slice("ws", F.col("at"), F.col("len")).alias("w")).distinct()


def _positions(docs: DataFrame, k: int) -> DataFrame:
    """Every position of a document with the hash of the k words from there; ws stays at hand in the same stage."""
    each = docs.filter(F.size("ws") >= k).select("*", F.posexplode("ws").alias("pos", "_word"))
    return each.filter(F.col("pos") <= F.size("ws") - k).withColumn("h", shingle_hash(F.col("ws"), F.col("pos"), k))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    shingle: int = 5,
    least_share: int = 20,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated if n_hit > 0 and least_share * n_hit >= n_words.
    Null texts and texts without words have no hit; null item texts no window; a null item
    identifier is left out of the list of items. Rows that repeat an identifier are told
    apart by their texts. Empty tables give no rows, or rows without hits. Other columns are
    ignored, whatever their names.
    """
    how = (item_id_col, item_text_col, window, shingle, least_share, broadcast_rows)
    return _judged(docs, items, id_col, text_col, *how).drop("th")


def _judged(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    shingle: int = 5,
    least_share: int = 20,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """The rows of decontaminate(), each with th, the hash of its text."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    words = base.select("doc_id", F.xxhash64("t").alias("th"), words_of(F.col("t")).alias("ws"))
    holding = stash(item_windows(items, item_id_col, item_text_col, window), "holding")
    # Numbers given once and written: a window travels as its number, its items join in at the end.
    windows = stash(holding.select("w", "len").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    items_of = holding.filter("item is not null").join(windows, ["w", "len"]).select("wid", "item")
    lengths = sorted(r[0] for r in windows.select(F.least("len", F.lit(shingle))).distinct().collect())  # at most `shingle` values
    hits = None
    for k in lengths:
        of_k = windows.filter(F.col("len") >= k) if k == shingle else windows.filter(F.col("len") == k)
        every = of_k.select("w", "len", "wid", F.explode(F.sequence(F.lit(0), F.col("len") - k)).alias("off"))
        every = every.withColumn("h", shingle_hash(F.col("w"), F.col("off"), k))
        found = _matches(words, every, k, window, broadcast_rows)
        hits = found if hits is None else hits.union(found)
    counts = words.select("doc_id", "th", F.size("ws").cast("long").alias("n_words"))
    if hits is None:
        hits = words.select("doc_id", "th", F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("wid")).limit(0)
    hits = stash(hits, "hits")
    # Bounded by one document's own positions; sets, so repeated rows count once.
    per_doc = hits.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"))
    held = hits.select("doc_id", "th", "wid").distinct().join(items_of, "wid").select(F.col("doc_id").alias("_i"), F.col("th").alias("_h"), "item").distinct()
    held = held.groupBy("_i", "_h").agg(F.array_sort(F.collect_list("item")).alias("items"))  # the answer asks for all of one document's
    per_doc = per_doc.join(held, F.col("doc_id").eqNullSafe(F.col("_i")) & F.col("th").eqNullSafe(F.col("_h")), "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(x["start"], s["upto"]))).alias("n"),
            F.greatest(s["upto"], x["start"] + x["len"]).alias("upto"),
        ),
        lambda s: s["n"],
    )
    per_doc = per_doc.select(
        F.col("doc_id").alias("_d"), F.col("th").alias("_t"), covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("list")
    )
    joined = counts.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        "th",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("list", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (least_share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _small(rows: DataFrame, words: Column, most: int) -> bool:
    """Whether rows may be broadcast: by their number and by the bytes of their words."""
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(words)), F.lit(0))).first()
    return n <= most and size <= BROADCAST_BYTES


def _matches(words: DataFrame, every: DataFrame, k: int, window: int, broadcast_rows: int) -> DataFrame:
    """doc_id, th, start, len, wid of every verified occurrence of a window."""
    hashes = every.select("h").distinct()
    at = _positions(words, k)
    if _small(hashes, F.lit(""), broadcast_rows):
        counts = at.select("h").join(F.broadcast(hashes), "h").groupBy("h").count()
    else:  # counted before they meet, so that a frequent shingle comes as few rows
        counts = at.groupBy("h").count().join(hashes.hint("merge"), "h")
    counts = stash(counts, "shingle-counts")
    # A window with a shingle that no document has can't occur; of the others the rarest shingle is the prefix.
    rated = every.join(counts, "h", "left").groupBy("w", "len", "wid").agg(
        F.min(F.coalesce("count", F.lit(0))).alias("least"), F.min_by("off", F.struct(F.coalesce("count", F.lit(0)), "off")).alias("off")
    )
    prefix = rated.filter("least > 0").withColumn("h", shingle_hash(F.col("w"), F.col("off"), k)).select("h", "off", "w", "len", "wid")
    prefix = stash(prefix, "prefixes")
    start = F.col("pos") - F.col("off")
    if _small(prefix, F.array_join("w", " "), broadcast_rows):
        found = at.join(F.broadcast(prefix), "h").withColumn("first", F.lit(0))
    else:
        # Rows that move take along the words that a window around the shingle can have, not the document. A shingle
        # that many documents have is a skewed key, which the merge join splits as it runs.
        first = F.greatest(F.lit(0), F.col("pos") - (window - k))
        at = at.select("doc_id", "th", "h", "pos", first.alias("first"), F.slice("ws", first + 1, F.lit(2 * window - k)).alias("ws"))
        found = at.join(prefix.hint("merge"), "h")
    end = F.size("ws") + F.col("first")
    found = found.filter((start >= 0) & (start + F.col("len") <= end))
    found = found.filter(F.slice("ws", start - F.col("first") + 1, F.col("len")) == F.col("w"))
    return found.select("doc_id", "th", start.alias("start"), "len", "wid")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the contaminated ones, by identifier and text, with its own columns, whatever their names.

    Other texts of the same identifier, or of none, stay; equal rows stay or go together.
    Null texts and texts without words stay, and all stay where there are no items.
    """
    bad = _judged(docs, items, id_col, text_col, **how).filter("contaminated").select(F.col("doc_id").alias("k"), F.col("th").alias("h")).distinct()
    k, h = unused(docs, "_k"), unused(docs, "_h")
    own = docs.withColumns({k: F.col(id_col).cast("long"), h: F.xxhash64(F.col(text_col).cast("string"))})
    return own.join(bad, own[k].eqNullSafe(bad["k"]) & (own[h] == bad["h"]), "left_anti").select(*docs.columns)
