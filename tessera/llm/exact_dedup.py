"""Exact deduplication by a tree merge of sorted digest runs.

Every row is put on one of `leaves` by a hash of its identifier. A leaf's run holds each
digest once, with the best identifier and the number of rows. In round r the runs of
`fan_in` neighbouring nodes meet (leaf // fan_in**r), dealt by node and digest range,
and are merged in sorted order; after the last round one run per digest range is left.
A group of copies of any size reaches a node as at most one row per child run, so no
task ever sees a whole group. The way down is two equi-joins, and the second has the leaf
in its key, which spreads a hot group over all leaves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stash, unused

RUN = "rng int, node int, sha binary, n_bytes long, check long, best long, n long"


def _merge(keep_largest: bool):
    """Merges sorted rows: equal (rng, node, sha, n_bytes, check) become one row."""

    def run(batches):
        carry = None
        for batch in batches:
            piece = pa.Table.from_batches([batch])
            piece = piece if carry is None else pa.concat_tables([carry, piece]).combine_chunks()
            if piece.num_rows == 0:
                continue
            out = _collapse(piece, keep_largest)
            carry = out.slice(out.num_rows - 1)
            if out.num_rows > 1:
                yield from out.slice(0, out.num_rows - 1).combine_chunks().to_batches()
        if carry is not None:
            yield from carry.combine_chunks().to_batches()

    return run


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype="<u8").reshape(-1, 4)


def _collapse(t: pa.Table, keep_largest: bool) -> pa.Table:
    key = np.column_stack(
        [_digests(t["sha"]).view(np.int64)]
        + [t[c].to_numpy().astype(np.int64) for c in ("rng", "node", "n_bytes", "check")]
    )
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    worst = np.iinfo(np.int64).min if keep_largest else np.iinfo(np.int64).max
    best = t["best"].combine_chunks()
    known = np.asarray(best.is_valid())
    ids = np.where(known, best.fill_null(0).to_numpy(), worst)
    pick = np.maximum if keep_largest else np.minimum
    top, any_known = pick.reduceat(ids, starts), np.logical_or.reduceat(known, starts)
    head = t.take(pa.array(starts))
    return head.set_column(
        head.column_names.index("best"), "best", pa.array(top, mask=~any_known)
    ).set_column(head.column_names.index("n"), "n", pa.array(np.add.reduceat(t["n"].to_numpy(), starts)))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    fan_in: int = 8,
    leaves: int | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are one group when SHA-256, byte length and a second 64-bit hash all agree.
    keep: "smallest" or "largest" identifier of a group stays. ranges: digest ranges, which
    bound the tasks of the last round; by default four for each shuffle partition.

    Null text counts as empty. A null identifier never wins unless its group has no other;
    rows that repeat an identifier and a text are all marked kept when that identifier
    stays. Empty input gives no rows. Other columns are ignored, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark, largest = docs.sparkSession, keep == "largest"
    parts = shuffle_partitions(spark)
    leaves = leaves or max(fan_in, parts)
    ranges = ranges or max(256, 4 * parts)
    row = F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()))  # rows without an identifier are spread, too
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t")).select(
        "doc_id",
        F.unhex(F.sha2("t", 256)).alias("sha"),
        F.octet_length("t").cast("long").alias("n_bytes"),
        F.xxhash64("t").alias("check"),
        F.pmod(row, F.lit(leaves)).cast("int").alias("node"),
    )
    hashed = stash(hashed, "digests")  # the texts are read and hashed once
    run = hashed.groupBy("node", "sha", "n_bytes", "check").agg(
        (F.max if largest else F.min)("doc_id").alias("best"), F.count(F.lit(1)).alias("n")
    )
    run = run.select((F.conv(F.hex(F.substring("sha", 1, 6)), 16, 10).cast("long") % ranges).cast("int").alias("rng"), "node", "sha", "n_bytes", "check", "best", "n")
    first = stash(run, "runs")
    level, nodes = first, leaves
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        level = (
            level.withColumn("node", F.floor(F.col("node") / fan_in).cast("int"))
            .repartition(parts, "rng", "node")
            .sortWithinPartitions("rng", "node", "sha", "n_bytes", "check")
            .mapInArrow(_merge(largest), RUN)
        )
    key = ["sha", "n_bytes", "check"]
    groups = level.filter("n > 1").select(*key, F.col("best").alias("keep_id"), F.col("n").alias("size"))
    told = first.select("node", *key).join(groups, key)
    return (
        hashed.join(told, ["node", *key], "left")
        .select(
            "doc_id",
            F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
        .select("doc_id", "keep_id", "group_size", F.expr("keep_id <=> doc_id").alias("kept"), "text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the copies, with its own columns, whatever their names.

    Of rows that repeat an identifier and a text one stays. Null texts and empty ones are
    copies of each other. Of a group without any identifier one row stays.
    """
    kept = exact_groups(docs, id_col, text_col, **how).filter("kept").select(F.col("doc_id").alias("k"), F.col("text_sha256").alias("h")).distinct()
    k, h = unused(docs, "_k"), unused(docs, "_h")
    own = docs.withColumns({k: F.col(id_col).cast("long"), h: F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)})
    joined = own.join(kept, (own[h] == kept["h"]) & own[k].eqNullSafe(kept["k"]), "left_semi")
    return joined.dropDuplicates([k, h]).select(*docs.columns)
