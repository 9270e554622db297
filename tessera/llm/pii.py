"""Personal data: base patterns, and bootstrapped contextual extraction.

One pass over the texts finds what the base patterns match (the seeds) and other strings
that look like identifiers (the candidates), each with the words around it. The rest is
Spark: contexts are patterns, strings are instances, and their graph is scored in rounds. A
pattern is as sure as the share of its instances known to be of its kind, where those of no
known kind count less; a new instance is as sure as the patterns that hold it. Patterns of high confidence then name the kind of
candidates that no base pattern matches.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

KINDS = ("email", "ip", "card", "phone")
#: Fixed base patterns. Possessive, and begun at the start of a run only, where that changes no match: a long run is read once.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Strings that look like identifiers without being matched above: what follows an @ that is spelt out, and numbers.
AT = re.compile(r"(?P<gap> ?)(?:\(at\)|\[at\]|(?<= )at(?= )) ?")
SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|(?<= )dot(?= )|\.) ?[A-Za-z0-9-]++)++")
NUMBER = re.compile(r"(?<![0-9])[0-9][0-9().\x20/-]{4,40}[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile("[0-9]")
BROADCAST_PATTERNS = 50_000
MENTION = "struct<kind:string,begin:int,finish:int,patterns:array<string>,instance:string>"


def luhn(digits: str) -> bool:
    """Check digit test: every second digit from the right counts double, with the digits of the double added."""
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _local_start(text: str, end: int, least: int) -> int:
    """Where the run of local-part characters before `end` begins, not before `least`."""
    a = end
    while a > least and text[a - 1] in LOCAL_CHARS:
        a -= 1
    return a


def _emails(text: str):
    """Matches of local part, @, domain: a match takes the whole run before its @, so every @ is tried once."""
    at, done = text.find("@"), 0
    while at >= 0:
        a = _local_start(text, at, done)
        found = DOMAIN.match(text, at + 1) if a < at else None
        done = found.end() if found else at + 1
        if found:
            yield a, done
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of the base matches, by kind as listed and start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def _spelt(text: str):
    """Addresses with the @ spelt out, told from their spelt @ outward."""
    done = 0
    for m in AT.finditer(text):
        a = _local_start(text, m.start(), done)
        found = SPELT_DOMAIN.match(text, m.end()) if a < m.start() and m.start() >= done else None
        if found:
            done = found.end()
            yield a, done


def _candidates(text: str, taken: list[tuple[int, int]]):
    found = [m.span() for m in NUMBER.finditer(text) if sum(c.isdigit() for c in m[0]) >= 6]
    found += _spelt(text)
    last = at = 0
    taken = sorted(taken)
    for a, b in sorted(found):
        if a < last:
            continue
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if not any(x < b and a < y for x, y in taken[at : at + 4]):  # spans of a kind don't overlap: four kinds
            last = b
            yield a, b


def _patterns(text: str, a: int, b: int, around: int) -> list[str]:
    """Two words before; the word before with the word after. Words are looked for in `around` characters on either side."""
    left = [w.strip(".,;:()\"'").lower() for w in text[max(0, a - around) : a].split()][-2:]
    right = [w.strip(".,;:()\"'").lower() for w in text[b : b + around].split()][:1]
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    return out


def _instance(found: str) -> str:
    """What two mentions of one identifier share; a digest where it is long."""
    plain = re.sub(r"[^a-z0-9@]+", "", found.lower())
    return plain if len(plain) <= 64 else hashlib.sha256(plain.encode()).hexdigest()


def _mentions(around: int):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("finish", pa.int32()), ("patterns", pa.list_(pa.string())), ("instance", pa.string())]))

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py() or ""
                row = base_spans(text)
                if DIGIT.search(text) or AT.search(text):
                    row += [(None, a, b) for a, b in _candidates(text, [(a, b) for _, a, b in row])]
                rows.append([{"kind": k, "begin": a, "finish": b, "patterns": _patterns(text, a, b, around), "instance": _instance(text[a:b])} for k, a, b in row])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, kind)], names=["k", "th", "mentions"])

    return run


def sure_patterns(edges: DataFrame, rounds: int, least_confidence: float, least_instances: int, doubt: float = 0.25) -> DataFrame:
    """edges (pattern, instance, seed kind or null) -> (pattern, found, conf) of high confidence.

    An instance weighs 1 if it is a seed of any kind, else `doubt`: not being known is weak
    evidence against a pattern. Round by round: pattern confidence = mass of the kind /
    (weight of all instances + 1), where a seed of the kind adds 1 and another instance
    its own confidence times doubt; that one is 1 - prod(1 - confidence of its accepted
    patterns).
    """
    edges = stash(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pii-edges")
    weight = F.when(F.col("kind").isNull(), F.lit(doubt)).otherwise(F.lit(1.0))
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w")).filter(F.col("n") >= least_instances).select("pattern", "w")
    seeds = edges.filter("kind is not null").select("pattern", "kind", F.lit(1.0).alias("mass"))
    others = edges.filter("kind is null").select("pattern", "instance")
    known, sure = seeds, None
    for i in range(rounds):
        mass = known.groupBy("pattern", "kind").agg(F.sum("mass").alias("mass"))
        sure = mass.join(size, "pattern").filter(F.col("mass") >= least_instances).withColumn("conf", F.col("mass") / (F.col("w") + 1))
        sure = stash(sure.filter(F.col("conf") >= least_confidence).select("pattern", F.col("kind").alias("found"), "conf"), "pii-patterns")
        if i + 1 < rounds:
            rated = others.join(sure, "pattern").groupBy("instance", "found").agg((1 - F.product(1 - F.col("conf"))).alias("conf"))
            known = seeds.union(others.join(rated, "instance").select("pattern", F.col("found").alias("kind"), (F.col("conf") * doubt).alias("mass")))
    return sure


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 3,
    least_confidence: float = 0.8,
    least_instances: int = 5,
    around: int = 80,
    doubt: float = 0.25,
) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and base_sha256 tell of the base matches; spans also has what the patterns
    discovered, as kind:start:end by kind and start, in code points, ends exclusive. The
    words of a context are looked for in `around` characters on either side of a mention.
    Null text counts as empty. Rows that repeat an identifier are told apart by their
    texts, equal rows get equal answers; a null identifier is one like any other. Empty
    input gives no rows. Other columns are ignored, whatever their names.
    """
    text = F.col(text_col).cast("string")
    found = stash(
        docs.select(F.col(id_col).cast("long").alias("k"), text.alias("t"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th")).mapInArrow(
            _mentions(around), f"k long, th long, mentions array<{MENTION}>"
        ),
        "mentions",
    )
    each = found.filter(F.size("mentions") > 0).select("k", "th", F.explode("mentions").alias("m")).select("k", "th", "m.*")
    edges = each.select(F.explode("patterns").alias("pattern"), "instance", "kind")
    sure = sure_patterns(edges, rounds, least_confidence, least_instances, doubt)
    # Few patterns are sure: counted, they go to the candidates; many meet them in a join that splits a hot pattern.
    few = sure.count() <= BROADCAST_PATTERNS
    named = each.filter("kind is null").select("k", "th", "begin", "finish", F.explode("patterns").alias("pattern")).join(F.broadcast(sure) if few else sure, "pattern")
    best = named.groupBy("k", "th", "begin", "finish").agg(F.max_by("found", F.struct("conf", "found")).alias("kind"))
    more = best.groupBy("k", "th").agg(F.collect_set(F.struct("kind", "begin", "finish")).alias("more")).withColumnsRenamed({"k": "k2", "th": "th2"})
    all_of = found.join(more, F.col("k").eqNullSafe(F.col("k2")) & (F.col("th") == F.col("th2")), "left")
    base = F.transform(F.filter("mentions", lambda m: m["kind"].isNotNull()), lambda m: F.struct(m["kind"].alias("kind"), m["begin"].alias("begin"), m["finish"].alias("finish")))
    all_of = all_of.select("k", base.alias("base"), F.coalesce("more", F.expr("array()")).alias("more"))
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = lambda c: F.array_sort(F.transform(c, lambda s: F.struct(rank(s).alias("r"), s["begin"].alias("b"), s["finish"].alias("f"), s["kind"].alias("k"))))
    joined = lambda c: F.array_join(F.transform(keyed(c), lambda s: F.concat_ws(":", s["k"], s["b"].cast("string"), s["f"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return all_of.select(
        F.col("k").alias("doc_id"),
        *[number(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "more")).alias("spans"),
    )
