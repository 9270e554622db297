"""Secret scans: token patterns, and sliding-window entropy of candidate strings.

DataFrame functions only. Where a pattern matches is told by what lies between its
matches: the lengths of the gaps and of the matches before it add up to its start.
The entropy of a window follows from sum(c * log2 c) over the counts of its characters,
which one step changes in two places, so a candidate is read once whatever the window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed patterns, in the order in which spans of one start are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a shorter run after AKIA holds no longer one, so the length can stand in the pattern
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Candidates that are no secrets: identifiers with dashes, digits only, letters only, repeated marks, dashed or slashed
#: words and numbers. Possessive, so that a long candidate is read once.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9_/+=-]++$",
    r"^[A-Za-z_/+=-]++$",
    r"^(.{1,4})\1++.{0,4}$",
    r"^(?:(?:[A-Za-z]++[0-9]{0,4}+|[0-9]{1,8}+)?+[-_/])++(?:[A-Za-z]++[0-9]{0,4}+|[0-9]{0,8}+)$",
)


def located(docs: DataFrame, kind: str, pattern: str, hint: str | None = None) -> DataFrame:
    """k, th, kind, start, end, match of all leftmost non-overlapping matches; positions in code points."""
    hit = docs.filter(F.col("t").rlike(hint or pattern))
    parts = F.arrays_zip(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("m"), F.split("t", pattern, -1).alias("g"))
    each = hit.select("k", "th", F.posexplode(parts).alias("p", "x")).select("k", "th", "p", F.col("x.m").alias("m"), F.char_length("x.g").alias("gap"))
    before = W.partitionBy("k", "th").orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce(F.char_length("m"), F.lit(0))).over(before)
    rows = each.dropDuplicates(["k", "th", "p"]).withColumn("end", end).filter("m is not null")
    return rows.select("k", "th", F.lit(kind).alias("kind"), (F.col("end") - F.char_length("m")).alias("start"), "end", "m")


def window_entropy(text: Column, window: int, low: str = "+", high: str = "z") -> Column:
    """Largest Shannon entropy, in bits, over the windows of `window` characters of a string at least so long.

    The characters lie between `low` and `high`. Their counts in the window are packed into
    a few longs, and one step changes one count up and one down, so the state and the work
    of a step don't grow with the string.
    """
    first, size = ord(low), ord(high) - ord(low) + 1
    bits = max(2, window.bit_length())
    per = 63 // bits
    gain = [n * math.log2(n) if n > 1 else 0.0 for n in range(window + 2)]
    gain = F.array(*[F.lit(b - a) for a, b in zip(gain, gain[1:])])  # of a count that goes from n to n + 1
    start = F.struct(
        F.array(*[F.lit(0).cast("long")] * -(-size // per)).alias("c"), F.lit(0.0).alias("s"), F.lit(float("inf")).alias("least")
    )
    slot = lambda code: F.floor(code / per).cast("int")
    shift = lambda code: (code % per) * bits
    one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), shift(code))

    def least(codes: Column) -> Column:
        def count(state: Column, code: Column) -> Column:
            packed = F.get(state["c"], slot(code))
            return F.call_function("shiftrightunsigned", packed, shift(code)).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")

        def step(state: Column, i: Column) -> Column:
            into, gone = F.get(codes, i), F.get(codes, i - window)  # gone is null while the window fills
            counts = F.transform(
                state["c"],
                lambda packed, j: packed
                + F.when(j == slot(into), one(into)).otherwise(F.lit(0).cast("long"))
                - F.when(j == slot(gone), one(gone)).otherwise(F.lit(0).cast("long")),
            )
            lost = F.coalesce(F.get(gain, count(state, gone) - 1), F.lit(0.0))
            change = F.when(into.eqNullSafe(gone), F.lit(0.0)).otherwise(F.get(gain, count(state, into)) - lost)
            s = state["s"] + change
            return F.struct(counts.alias("c"), s.alias("s"), F.when(i >= window - 1, F.least(state["least"], s)).otherwise(state["least"]).alias("least"))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda st: st["least"])

    letters = F.transform(F.split(text, ""), lambda c: F.ascii(c) - first)
    low_sum = F.transform(F.array(letters), least)[0]  # one array, read by index
    return F.log2(F.lit(float(window))) - low_sum / window


def entropy_spans(docs: DataFrame, window: int, hex_bits: float, mixed_bits: float, allowed: tuple[str, ...]) -> DataFrame:
    """Candidates whose most varied window passes the bound of their character class."""
    found = located(docs, "entropy", CANDIDATE)
    for pattern in allowed:
        found = found.filter(~F.col("m").rlike(pattern))
    is_hex = F.col("m").rlike("^[0-9a-f]+$") | F.col("m").rlike("^[0-9A-F]+$")
    bits = F.when(is_hex, F.lit(hex_bits)).otherwise(F.lit(mixed_bits))
    return found.filter(window_entropy(F.col("m"), window) >= bits)


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 20,
    hex_bits: float = 2.8,
    mixed_bits: float = 3.6,
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end with code points and an exclusive end, by start and then kind.
    An entropy span that meets a base span of its document is left out.
    Null text counts as empty: no spans. Rows that repeat an identifier are told apart by
    their texts, equal rows get equal answers; a null identifier is one like any other.
    Empty input gives no rows. Other columns are ignored, whatever their names.
    """
    own = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    own = own.withColumn("th", F.xxhash64("t"))
    long_value = F.char_length(F.regexp_extract("m", ASSIGN, 2)) >= 12
    base = located(own, "assign", ASSIGN, ASSIGN_HINT).filter(long_value).union(located(own, "access", ACCESS)).union(located(own, "hex", HEX))
    spans = base.union(entropy_spans(own, window, hex_bits, mixed_bits, allowed)).select(
        "k", "th", F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("rank"), "end", "kind").alias("s")
    )
    per = spans.groupBy("k", "th").agg(F.array_sort(F.collect_list("s")).alias("all"))  # of one document's own text
    named = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    is_base = lambda s: s["rank"] < 4
    per = per.withColumn("base", F.filter("all", is_base))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    per = per.withColumn("all", F.filter("all", lambda s: is_base(s) | free(s)))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    per = per.select(F.col("k").alias("k2"), F.col("th").alias("th2"), *[number(k).alias(f"n_{k}") for k in KINDS[:3]], named(F.col("base")).alias("base"), named(F.col("all")).alias("spans"))
    joined = own.select("k", "th").join(per, F.col("k").eqNullSafe(F.col("k2")) & (F.col("th") == F.col("th2")), "left")
    return joined.select(
        F.col("k").alias("doc_id"),
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
