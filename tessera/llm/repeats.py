"""Removal of repeated passages with suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a document
with a smaller identifier, or before in the same one.

1. Every such string (a window) has an anchor: the `gram` bytes in it with the least hash,
   the first of equals. Equal windows have equal anchors, so only windows whose anchor
   occurs twice matter. Anchors are counted over all texts. Up to a stated number of
   repeated ones, a Bloom filter of a fixed size goes to all tasks; beyond it, anchors
   meet the repeated ones in a join and go back to their documents as lists. Either way
   only spares work: what a filter lets through in error is found to be alone later.
2. The windows of one anchor lie side by side. Their common context is sent to the shard of
   the anchor, its bytes once a task. Occurrences of the same context repeat the first one
   of them in full. An anchor with very many occurrences is dealt over several shards by
   document and place, whatever its contexts.
3. In a shard the different contexts that agree on enough bytes beside the anchor to share a
   window are sorted by their suffixes (Larsson-Sadakane refinement with ranks that double in
   depth), neighbours' common prefixes follow by Kasai's rule, and runs of `length` or more
   are equal windows: all but the earliest go.
   Windows that are first in their shard of a dealt-out anchor are merged across shards:
   each shard brings a sorted run of window digests (128 bits), and its windows are found
   among those merged before by binary search.
4. Removed ranges meet the texts again by document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stash

NO_ID = np.iinfo(np.int64).min
BLOOM_BITS = 1 << 25
_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _RNG.integers(1, 1 << 62, 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram bytes from each position; gram is a power of two."""
    h, n = _BYTE[b], 1
    for m in _MULT:
        if n == gram:
            break
        h = h[:-n] * m + h[n:]
        n *= 2
    h ^= h >> np.uint64(29)
    h *= _MULT[-1]
    return h ^ (h >> np.uint64(32))


def first_least(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the position of its least one, the first of equals, by doubling."""
    m, at, n = g, np.arange(len(g), dtype=np.int32), 1
    while 2 * n <= width:
        less = m[n:] < m[:-n]
        at = np.where(less, at[n:], at[:-n])
        m = np.where(less, m[n:], m[:-n])
        n *= 2
    r = width - n
    return np.where(m[r:] < m[:-r], at[r:], at[:-r]) if r else at


def anchors(raw: bytes, length: int, gram: int):
    """hash, first window, last window of each anchor of a text, in order; empty for a short text."""
    if len(raw) < length:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none
    g = gram_hashes(np.frombuffer(raw, np.uint8), gram)
    at = first_least(g, length - gram + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return g[at[first]], first, np.r_[first[1:], len(at)] - 1


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and ranks, of bytes.

    Larsson-Sadakane: groups of equal rank are refined by the rank `h` further on, h doubles,
    and suffixes that are alone in their group aren't touched again.
    """
    n = len(text)
    wide = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64)
    key = wide[:n].copy()
    for i in range(1, 8):
        key = key << np.uint64(8) | wide[i : i + n]
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank[n] = -1
    h = 8
    while True:
        head = rank[order]
        same = np.r_[head[1:] == head[:-1], False]
        open_ = np.flatnonzero(same | np.r_[False, same[:-1]])
        if not len(open_):
            break
        sub = order[open_]
        pair = head[open_] * (n + 2) + rank[np.minimum(sub + h, n)] + 1
        by = np.argsort(pair, kind="stable")
        sub, pair = sub[by], pair[by]
        order[open_] = sub
        new = np.r_[True, pair[1:] != pair[:-1]]
        rank[sub] = open_[np.flatnonzero(new)][np.cumsum(new) - 1]
        h *= 2
    return order, rank[:n]


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cap: int) -> np.ndarray:
    """For each position, the length shared with the suffix sorted before it, up to cap: Kasai's rule, one lane a context."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.r_[text.astype(np.int16), np.full(cap + 1, -1, np.int16)]
    out = np.zeros(n, np.int64)
    pos, end = starts.astype(np.int64).copy(), (starts + sizes).astype(np.int64)
    shared = np.zeros(len(starts), np.int64)
    while len(pos):
        prev = before[pos]
        grow = (prev >= 0) & (shared < cap)
        a, b = padded[np.minimum(pos + shared, n)], padded[np.minimum(prev + shared, n)]
        grow &= (a == b) & (a >= 0)
        stop = ~grow
        out[pos[stop]] = shared[stop]
        shared = np.where(grow, shared + 1, np.maximum(shared - 1, 0))
        pos = pos + stop
        if stop.any():
            live = pos < end
            if not live.all():
                pos, end, shared = pos[live], end[live], shared[live]
    return out


def repeated_windows(contexts: list[bytes], rank_of: np.ndarray, first: np.ndarray, length: int) -> list[np.ndarray]:
    """Per context a flag for each of its windows: an equal window stands earlier.

    Context i's window j starts at first[i] + j of the document with order rank_of[i].
    """
    sizes = np.array([len(c) for c in contexts])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    text = np.frombuffer(b"".join(contexts), np.uint8)
    order, rank = suffix_array(text)
    shared = common_prefixes(text, order, rank, starts, sizes, length)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(len(text)) - starts[owner]
    real = offset <= sizes[owner] - length
    # Suffixes that aren't windows break no run: they keep the least common prefix going.
    group = np.cumsum(shared[order] < length)
    at = order[real[order]]
    group = group[real[order]]
    doc, pos = rank_of[owner[at]], first[owner[at]] + offset[at]
    by = np.lexsort((pos, doc, group))
    lead = np.r_[True, group[by][1:] != group[by][:-1]]
    flags = np.zeros(len(text), bool)
    flags[at[by[~lead]]] = True
    return [flags[s : s + n - length + 1] for s, n in zip(starts, sizes)]


def with_partners(contexts: list[bytes], h: np.ndarray, group: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which contexts may share a window with another one of their group.

    A window holds the anchor and, on one side of it at least, half of its other bytes. So
    contexts of one anchor that share a window agree on that many bytes before the anchor or
    after it; a context that agrees with no other on either side needs no comparison.
    """
    half = (length - gram + 1) // 2
    sizes = np.array([len(c) for c in contexts])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    text = np.frombuffer(b"".join(contexts), np.uint8)
    g = gram_hashes(text, gram)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(g)]
    hit = np.flatnonzero(g == h[owner])
    hit = hit[hit + gram <= starts[owner[hit]] + sizes[owner[hit]]]
    at = np.full(len(sizes), -1)
    at[owner[hit][::-1]] = (hit - starts[owner[hit]])[::-1]  # the first of a context's
    keys, seen = [], {}
    for c, p, who in zip(contexts, at.tolist(), group.tolist()):
        left = (who, 0, c[p - half : p]) if p >= half else None
        right = (who, 1, c[p + gram : p + gram + half]) if p + gram + half <= len(c) else None
        keys.append((left, right))
        seen[left] = seen.get(left, 0) + 1
        seen[right] = seen.get(right, 0) + 1
    return np.array([p < 0 or (a is not None and seen[a] > 1) or (b is not None and seen[b] > 1) for (a, b), p in zip(keys, at.tolist())], bool)


def _text_rows(batch):
    for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
        raw = t.as_buffer().to_pybytes() if t.is_valid else b""
        yield (NO_ID if k is None else k), raw


def _count(length: int, gram: int):
    def run(batches):
        held, size = [], 0

        def total():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        for b in batches:
            for _, raw in _text_rows(b):
                held.append(anchors(raw, length, gram)[0])
                size += len(held[-1])
                if size > 1 << 20:
                    yield total()
                    size = 0
        if held:
            yield total()

    return run


def bloom(repeated: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of the hashes, as 64-bit words; at most bits / 64 rows reach the driver, whatever the input."""
    low = F.col("h").bitwiseAND(F.lit(bits - 1))
    high = F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1))
    slots = repeated.select(F.explode(F.array(low, high)).alias("s"))
    words = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(s & 63)))").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def _anchor_list(length: int, gram: int):
    def run(batches):
        for b in batches:
            for (k, raw), th in zip(_text_rows(b), b.column(2).to_pylist()):
                h = np.unique(anchors(raw, length, gram)[0])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), k)), pa.array(np.full(len(h), th))], names=["h", "k", "th"])

    return run


OCCURRENCE = "h long, salt int, c long, k long, th long, lo long, n int, ctx binary"


def _occurrences(length: int, gram: int, words, hot: dict[int, int]):
    """words: the broadcast Bloom filter, or None where each row brings the list of its repeated anchors."""
    digest = xxhash.xxh3_64_intdigest

    def by_filter(h):
        bits = words.value
        size, one, six, low = np.uint64(len(bits) * 64 - 1), np.uint64(1), np.uint64(6), np.uint64(63)
        a, z = h & size, (h >> np.uint64(32)) & size
        return np.flatnonzero((bits[a >> six] >> (a & low) & one) & (bits[z >> six] >> (z & low) & one))

    names = [x.split()[0] for x in OCCURRENCE.split(", ")]
    kinds = (np.int64, np.int32, np.int64, np.int64, np.int64, np.int64, np.int32)

    def run(batches):
        seen: set = set()
        cols: list[list[np.ndarray]] = [[] for _ in kinds]
        texts: list = []

        def batch():
            arrays = [pa.array(np.concatenate(c) if c else np.empty(0, t), pa.from_numpy_dtype(t)) for c, t in zip(cols, kinds)]
            arrays.append(pa.array(texts, pa.binary()))
            for c in (*cols, texts):
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for b in batches:
            for i, ((k, raw), th) in enumerate(zip(_text_rows(b), b.column(2).to_pylist())):
                if words is None and not b.column(3)[i].is_valid:
                    continue
                h, lo, hi = anchors(raw, length, gram)
                hit = by_filter(h) if words else np.flatnonzero(np.isin(h.view(np.int64), b.column(3)[i].values.to_numpy()))
                if not len(hit):
                    continue
                x, lo, hi = h[hit].view(np.int64), lo[hit], hi[hit]
                salt = np.array([(31 * k + s) % hot.get(a, 1) for a, s in zip(x.tolist(), lo.tolist())], np.int32) if hot else np.zeros(len(x), np.int32)
                digests = []
                for s, e, deal in zip(lo.tolist(), (hi + length).tolist(), salt.tolist()):
                    ctx = raw[s:e]
                    c = digest(ctx)
                    digests.append(c)
                    mark = (c, deal) if deal else c
                    if mark in seen:
                        texts.append(None)
                    else:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(mark)
                        texts.append(ctx)
                one = (x, salt, np.array(digests, np.uint64).view(np.int64), np.full(len(x), k), np.full(len(x), th), lo, (hi - lo + 1).astype(np.int32))
                for col, v in zip(cols, one):
                    col.append(v)
                if len(texts) > 20_000:
                    yield batch()
        yield batch()

    return run


RANGES = "k long, th long, start long, stop long, digest binary, shard int"
SLICES = 64  # a merging task takes its digests in so many slices, one at a time


def _shard(length: int, gram: int, hot: dict[int, int]):
    """Rows sorted by (h, salt, c, k, th, lo) -> removed ranges; with a digest, windows to be merged across shards."""

    def run(batches):
        left = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if left is None else pa.concat_tables([left, t])
            h, salt = t["h"].to_numpy(), t["salt"].to_numpy()
            if not len(h):
                continue
            cut = int(np.flatnonzero((h != h[-1]) | (salt != salt[-1]))[-1]) + 1 if (h[0], salt[0]) != (h[-1], salt[-1]) else 0
            left = t.slice(cut).combine_chunks()
            if cut:
                yield from done(t.slice(0, cut))
        if left is not None:
            yield from done(left)

    def done(t):
        h, salt, c, k, th, lo, n = (t[x].to_numpy() for x in ("h", "salt", "c", "k", "th", "lo", "n"))
        ctx = t["ctx"].combine_chunks()
        key = np.r_[True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]) | (c[1:] != c[:-1])]
        again = np.r_[False, ~key[1:] & (k[1:] == k[:-1]) & (th[1:] == th[:-1]) & (lo[1:] == lo[:-1])]  # a repeated row
        rest = np.flatnonzero(~key & ~again)
        if len(rest):
            yield out(k[rest], th[rest], lo[rest], lo[rest] + n[rest] + length - 1)
        firsts = np.flatnonzero(key)
        with_bytes = np.flatnonzero(np.asarray(ctx.is_valid()))
        bytes_at = with_bytes[np.searchsorted(with_bytes, firsts)]  # a context has its bytes somewhere in its run
        group = np.cumsum(np.r_[True, (h[firsts][1:] != h[firsts][:-1]) | (salt[firsts][1:] != salt[firsts][:-1])]) - 1
        several = np.bincount(group)[group] > 1
        dealt = np.array([x in hot for x in h[firsts].tolist()]) if hot else np.zeros(len(firsts), bool)
        pick = np.flatnonzero(several | dealt)
        cuts = [0]  # whole groups only
        while cuts[-1] < len(pick):
            e = min(cuts[-1] + 8192, len(pick))
            while e < len(pick) and group[pick[e]] == group[pick[e - 1]]:
                e += 1
            cuts.append(e)
        for s, e in zip(cuts, cuts[1:]):
            part = pick[s:e]
            rows = firsts[part]
            raw = ctx.take(pa.array(bytes_at[part])).to_pylist()
            ids = np.lexsort((th[rows], k[rows]))
            rank = np.empty(len(rows), np.int64)
            ids_new = np.r_[True, (k[rows][ids][1:] != k[rows][ids][:-1]) | (th[rows][ids][1:] != th[rows][ids][:-1])]
            rank[ids] = np.cumsum(ids_new)
            flags = [np.zeros(len(c) - length + 1, bool) for c in raw]
            close = np.flatnonzero(with_partners(raw, h[rows].view(np.uint64), group[part], length, gram))
            if len(close):
                for i, f in zip(close.tolist(), repeated_windows([raw[i] for i in close], rank[close], lo[rows][close], length)):
                    flags[i] = f
            found = [[], [], [], []]
            wait = [[], [], [], [], [], []]
            for r, f, text, is_dealt in zip(rows.tolist(), flags, raw, dealt[part]):
                edge = np.flatnonzero(np.diff(np.r_[0, f.view(np.int8), 0]))
                for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    for col, v in zip(found, (k[r], th[r], lo[r] + a, lo[r] + z - 1 + length)):
                        col.append(v)
                if is_dealt:
                    for j in np.flatnonzero(~f).tolist():
                        for col, v in zip(wait, (k[r], th[r], lo[r] + j, lo[r] + j + length, xxhash.xxh3_128_digest(text[j : j + length]), salt[r])):
                            col.append(v)
            if found[0]:
                yield out(*map(np.array, found))
            if wait[0]:
                yield out(*map(np.array, wait[:4]), *wait[4:])

    def out(k, th, a, z, digest=None, shard=None):
        d = pa.array(digest, pa.binary()) if digest is not None else pa.nulls(len(k), pa.binary())
        s = pa.array(np.array(shard, np.int32)) if shard is not None else pa.nulls(len(k), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k, th, a, z)] + [d, s], names=["k", "th", "start", "stop", "digest", "shard"])

    return run


def _merge(batches):
    """Rows sorted by (slice, shard, digest) -> the windows that also stand earlier, in another shard."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        at = t["slice"].to_numpy()
        cut = int(np.searchsorted(at, at[-1]))
        held = t.slice(cut)
        if cut:
            yield from _later(t.slice(0, cut))
    if held is not None:
        yield from _later(held)


def _later(t: pa.Table):
    """Merges the shards' runs slice by slice; a window found among those merged before loses to the earlier of the two."""
    t = t.combine_chunks()
    digest = np.array(t["digest"].to_pylist(), dtype="S16")
    k, th, start = (t[c].to_numpy() for c in ("k", "th", "start"))
    place = np.empty(len(k), np.int64)
    place[np.lexsort((start, th, k))] = np.arange(len(k))
    part, shard = t["slice"].to_numpy(), t["shard"].to_numpy()
    runs = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (shard[1:] != shard[:-1]), True])
    gone = np.zeros(len(k), bool)
    merged = np.empty(0, digest.dtype)
    lead = np.empty(0, np.int64)  # the row that holds each merged digest first
    for i, (s, e) in enumerate(zip(runs, runs[1:])):
        if i and part[s] != part[runs[i - 1]]:
            merged, lead = merged[:0], lead[:0]
        at = np.searchsorted(merged, digest[s:e])
        known = np.flatnonzero((at < len(merged)) & (merged[np.minimum(at, len(merged) - 1)] == digest[s:e])) if len(merged) else np.empty(0, np.int64)
        old, new = lead[at[known]], s + known
        first = place[new] < place[old]
        gone[np.where(first, old, new)] = True
        lead[at[known]] = np.where(first, new, old)
        fresh = np.setdiff1d(np.arange(e - s), known)
        merged, lead = np.insert(merged, at[fresh], digest[s:e][fresh]), np.insert(lead, at[fresh], s + fresh)
    left = t.select([c.split()[0] for c in RANGES.split(", ")]).filter(pa.array(gone))
    yield from left.to_batches()


def _remove(batches):
    for b in batches:
        rows = [[], [], [], [], []]
        for k, t, ranges in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            spans: list[list[int]] = []
            for r in sorted((r["start"], r["stop"]) for r in ranges or ()):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            kept, at = hashlib.sha256(), 0
            for s, e in spans:
                kept.update(raw[at:s])
                at = e
            kept.update(raw[at:])
            for col, v in zip(rows, (k, len(raw), sum(e - s for s, e in spans), len(spans), kept.hexdigest())):
                col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 100,
    gram: int = 16,
    hot_rows: int | None = None,
    bloom_bits: int = BLOOM_BITS,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    hot_rows: an anchor with more occurrences is dealt over several shards; by default
    half of what a shuffle partition has on average. bloom_bits: the filter's size, a
    power of two; it is used for up to an eighth as many repeated anchors.

    Null text counts as empty; a null identifier comes before all others. Rows with one
    identifier and different texts are ordered by a hash of the text; rows that repeat both
    are one document and get equal answers. Empty input gives no rows. Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("k"), text.cast("binary").alias("t"), F.xxhash64(text).alias("th"))
    counts = own.mapInArrow(_count(length, gram), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    repeated = stash(counts.filter("n > 1"), "anchors")
    total, distinct = repeated.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    limit = hot_rows or max(1_000, total // (2 * parts))
    # No more than total / limit anchors can have so many occurrences: twice the partitions at most.
    hot = {r["h"]: int(-(-r["n"] // limit)) for r in repeated.filter(F.col("n") > limit).collect()}
    if distinct <= bloom_bits // 8:
        words = spark.sparkContext.broadcast(bloom(repeated, bloom_bits))
        found = own.mapInArrow(_occurrences(length, gram, words, hot), OCCURRENCE)
    else:
        some = own.mapInArrow(_anchor_list(length, gram), "h long, k long, th long").join(repeated.select("h"), "h", "left_semi")
        lists = some.groupBy("k", "th").agg(F.collect_set("h").alias("hs")).withColumnsRenamed({"k": "k2", "th": "th2"})  # of one document
        each = own.join(lists, (F.coalesce("k", F.lit(NO_ID)) == F.col("k2")) & (F.col("th") == F.col("th2")), "left")
        found = each.select("k", "t", "th", "hs").mapInArrow(_occurrences(length, gram, None, hot), OCCURRENCE)
    ranges = (
        found.repartition(parts, "h", "salt")
        .sortWithinPartitions("h", "salt", "c", "k", "th", "lo")
        .mapInArrow(_shard(length, gram, hot), RANGES)
    )
    if hot:
        ranges = stash(ranges, "ranges")
        late = ranges.filter("digest is not null").withColumn("slice", F.pmod(F.xxhash64("digest"), F.lit(SLICES)))
        late = late.repartition(parts, "digest").sortWithinPartitions("slice", "shard", "digest")
        ranges = ranges.filter("digest is null").union(late.mapInArrow(_merge, RANGES))
    per_doc = ranges.groupBy("k", "th").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))  # of one document's own text
    per_doc = per_doc.withColumnsRenamed({"k": "k2", "th": "th2"})
    joined = own.join(per_doc, (F.coalesce("k", F.lit(NO_ID)) == F.col("k2")) & (F.col("th") == F.col("th2")), "left")
    return joined.select("k", "t", "ranges").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
