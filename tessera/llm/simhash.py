"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming links, components.

A fingerprint is cut into `blocks` parts. Two fingerprints within `radius` bits differ in
at most `radius` parts, so they agree on some choice of blocks - radius parts; each such
choice is a join key. Rows of one key meet in one task as a sorted stream. Small buckets
are compared shift by shift; large ones (a dense family of near copies) are linked through
the points one bit away: two fingerprints are within two bits exactly when they share such
a point, so the work grows with the bucket, not with its square, and no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stash, unused
from .components import components

SMALL = 16
SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of word shingles; 0 if there is no word."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]]
    digest = xxhash.xxh64_digest
    total, n = np.zeros(64, dtype=np.int64), len(words) - k + 1
    first, last = starts[:n].tolist(), (ends[k - 1 :] - 1).tolist()
    for i in range(0, n, 50_000):
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(first[i : i + 50_000], last[i : i + 50_000])])
        total += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches):
        for b in batches:
            ids, hashes, texts = b.column(0), b.column(1), b.column(2)
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "th", "fp"])

    return run


def block_masks(blocks: int, radius: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _links(masks: list[int], radius: int):
    """Sorted rows (choice, key, fp) -> links (a, b) that join each bucket's close fingerprints."""

    def run(batches):
        held: list[np.ndarray] = []  # of one bucket at most, besides the batch at hand
        for b in batches:
            rows = np.column_stack([b.column(i).to_numpy() for i in range(3)]).astype(np.int64)
            if not len(rows):
                continue
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            if held and (held[-1][-1, :2] != rows[0, :2]).any():
                yield from _edges(np.concatenate(held), masks, radius)
                held = []
            if len(cuts):
                yield from _edges(np.concatenate([*held, rows[: cuts[-1]]]), masks, radius)
                held = []
            held.append(rows[cuts[-1] if len(cuts) else 0 :])
        if held:
            yield from _edges(np.concatenate(held), masks, radius)

    return run


def _edges(rows: np.ndarray, masks: list[int], radius: int):
    new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
    bucket = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(rows)])
    fp = rows[:, 2].view(np.uint64)
    small = sizes[bucket] <= SMALL
    out = []
    for d in range(1, SMALL):
        if not (sizes > d).any():
            break
        ok = (bucket[d:] == bucket[:-d]) & small[d:]
        i = np.flatnonzero(ok)
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
        out.append((fp[i], fp[i + d]))
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        out.append(_dense(np.unique(fp[s : s + n]), masks[rows[s, 0]], radius))
    a = np.concatenate([x for x, _ in out]) if out else np.empty(0, np.uint64)
    b = np.concatenate([x for _, x in out]) if out else np.empty(0, np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _dense(fp: np.ndarray, mask: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links of each component of a large bucket.

    For a radius of two bits: two apart at most means a common point one bit away, and no
    pair is looked at. Other radii compare block by block.
    """
    if radius != 2:
        return _compared(fp, radius)
    flips = np.array([0] + [1 << j for j in range(64) if not mask >> j & 1], np.uint64)
    node = np.tile(np.arange(len(fp)), len(flips))
    point = np.unique((fp[None, :] ^ flips[:, None]).ravel(), return_inverse=True)[1].ravel()
    by = np.argsort(point, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(point[by]) > 0])
    label = np.arange(len(fp))
    while True:
        low = np.minimum.reduceat(label[node[by]], cuts)[point]
        now = label.copy()
        np.minimum.at(now, node, low)
        now = now[now]
        if (now == label).all():
            break
        label = now
    i = np.flatnonzero(label != np.arange(len(fp)))
    return fp[i], fp[label[i]]


def _compared(fp: np.ndarray, radius: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Star links as of _dense, every fingerprint compared with the others a block at a time."""
    label = np.arange(len(fp))
    while True:
        now = label.copy()
        for s in range(0, len(fp), block):
            near = np.bitwise_count(fp[s : s + block, None] ^ fp[None, :]) <= radius
            now[s : s + block] = np.where(near, label[None, :], len(fp)).min(axis=1)
        now = now[now]
        if (now == label).all():
            break
        label = now
    i = np.flatnonzero(label != np.arange(len(fp)))
    return fp[i], fp[label[i]]


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 2,
    blocks: int = 5,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most `radius` bits.
    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows
    get the same answer. A null identifier counts for nothing unless its component has no
    other. Empty input gives no rows. Other columns are ignored, whatever their names.
    """
    return _grouped(docs, F.lit(""), id_col, text_col, shingle, radius, blocks).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _grouped(docs: DataFrame, text_hash: Column, id_col: str, text_col: str, shingle: int = 3, radius: int = 2, blocks: int = 5) -> DataFrame:
    """One row per input row: doc_id, th (text_hash), fp, root (one fingerprint of the component), component_id."""
    parts = shuffle_partitions(docs.sparkSession)
    masks = block_masks(blocks, radius)
    fps = stash(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash.alias("th"), F.col(text_col).cast("binary").alias("t"))
        .mapInArrow(_fingerprints(shingle), "doc_id long, th string, fp long"),
        "fingerprints",
    )
    reps = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "reps")
    keys = reps.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for m in masks])).alias("choice", "key")
    )
    links = (
        keys.select(F.col("choice").cast("long").alias("choice"), "key", "fp")
        .repartition(parts, "choice", "key")
        .sortWithinPartitions("choice", "key", "fp")
        .mapInArrow(_links(masks, radius), "a long, b long")
    )
    comp = components(links)
    root = reps.join(comp, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = root.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = root.join(least, "root").select("fp", "root", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "th", "fp", "root", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each component stays: the one whose identifier is the component's.

    Documents are told apart by identifier and text: rows that share an identifier, or have
    none, each stay or go with their own component. Where several texts of one component
    have its identifier, the first by hash stays; of rows that repeat both, one. Null and
    empty texts are one component. Columns are those of docs, whatever their names.
    """
    text_hash = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    stay = _grouped(docs, text_hash, id_col, text_col, **how).filter("doc_id <=> component_id").groupBy("root", F.col("doc_id").alias("_k")).agg(F.min("th").alias("_t")).select("_k", "_t")
    k, h = unused(docs, "_k"), unused(docs, "_h")
    own = docs.withColumns({k: F.col(id_col).cast("long"), h: text_hash})
    joined = own.join(stay, (own[h] == stay["_t"]) & own[k].eqNullSafe(stay["_k"]), "left_semi")
    return joined.dropDuplicates([k, h]).select(*docs.columns)
