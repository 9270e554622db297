"""Sum-of-squares online packing of token streams into fixed windows.

Each task packs what it reads, in reading order. A document longer than a window fills
whole windows first; its rest is placed, uncut, into the fill level that keeps the sum of
squared counts of partially filled windows smallest (counts are kept in one array by
level). When the stream ends, or when many windows are open, the open windows are drained:
pieces of the emptiest are cut and moved into the fullest, so at most one partial window is
left, and that is cut at powers of two, which need no padding. Nothing is shuffled, and a
task holds the ids of open windows only.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
MAX_OPEN = 2048
#: The shape of tokenizer for which WordTokenizer's short way holds; any other goes through the tokenizer itself.
NORMALIZERS = ("NFC", "Replace", "Lowercase")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CACHE_WORDS = 200_000
#: White space to Python alone: texts with any of these go through the tokenizer itself, as a whole.
BREAKS = re.compile(r"[\x1c-\x1f]")
#: Chunks with any of these go through the tokenizer itself.
ODD = re.compile("[\u0250-\U0010ffff\u00b2\u00b3\u00b9\u00bc-\u00be\u0130]")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(others)}


def splits_at_white_space(told: dict) -> bool:
    """Whether a tokenizer file has the shape that WordTokenizer takes the short way for."""
    norm, pre, model = (told.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps, cuts = norm.get("normalizers", []), pre.get("pretokenizers", [])
    return (
        tuple(n["type"] for n in steps) == NORMALIZERS
        and steps[1]["pattern"] == {"Regex": r"\s+"}
        and steps[1]["content"] == " "
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": SPLIT}
        and cuts[0]["invert"]
        and cuts[0]["behavior"] == "Removed"
        and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"])
        and model.get("type") == "BPE"
    )


class WordTokenizer:
    """Ids of a word-end BPE tokenizer file, by white-space chunks with bounded caches.

    Holds for tokenizers whose normalizer only composes, folds white space and lower-cases,
    and whose pre-tokenizer splits letters, single digits and runs of other marks: no token
    then crosses white space. Other characters than those of ODD are their own composed
    form, so only lower-casing is left to do; a chunk with one of ODD goes through the
    tokenizer itself, and so does a text of a file of another shape, or with an added token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.short_way = splits_at_white_space(told)
        self.added = [t["content"] for t in told.get("added_tokens", [])]
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            # Only printable ASCII stands for itself; control characters have letters of their own.
            letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
            ids = self.words[word] = np.array([t.id for t in self.model.tokenize(letters)], dtype="<u4").tobytes()
        return ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """The ids of chunks not seen before; full caches start anew."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        for c in chunks:
            if ODD.search(c):
                self.chunks[c] = self._whole(c)
            else:
                self.chunks[c] = self._word(c) if c.isalpha() else b"".join(map(self._word, PIECES.findall(c)))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if not self.short_way or BREAKS.search(text) or any(a in text for a in self.added):
            return self._whole(text)
        if text.isascii() or not ODD.search(text):
            chunks = text.lower().split()
        else:  # chunks with odd characters go through the tokenizer, as they are written
            chunks = [c if ODD.search(c) else c.lower() for c in text.split()]
        out = []
        for i in range(0, len(chunks), CACHE_WORDS // 4):
            part = chunks[i : i + CACHE_WORDS // 4]
            new = set(part).difference(self.chunks)
            if len(self.chunks) + len(new) > CACHE_WORDS:
                self.chunks.clear()
                new = set(part)
            self._learn(new)
            out.append(b"".join(map(self.chunks.__getitem__, part)))
        return b"".join(out)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Packer:
    """Online packing; place() takes (doc_id, ids) and finished rows are in self.rows."""

    def __init__(self, window: int, first_sequence: int, max_open: int = MAX_OPEN):
        self.window, self.next, self.max_open = window, first_sequence, max_open
        self.count = np.zeros(window + 1, np.int64)  # open windows by fill level
        self.open: dict[int, list[list]] = {}  # by level: windows, each a list of pieces
        self.n_open, self.rows = 0, []

    def close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def place(self, doc, ids: bytes) -> None:
        w, total = self.window, len(ids) // 4
        whole = total // w * w
        for s in range(0, whole, w):
            self.close([(doc, s, ids[4 * s : 4 * (s + w)], total)])
        size = total - whole
        if not size:
            return
        piece = (doc, whole, ids[4 * whole :], total)
        count = self.count
        # Change of the sum of squares when level h gives a window to level h + size; a full window leaves the sum.
        cost = 1 - 2 * count[: w - size + 1]
        cost[:-1] += 2 * count[size:w] + 1
        cost[0] = 2 * count[size] + 1
        usable = count[: w - size + 1] > 0
        usable[0] = True
        cost = np.where(usable, cost, np.iinfo(np.int64).max)
        level = len(cost) - 1 - int(np.argmin(cost[::-1]))  # of equals the fullest
        if level:
            pieces = self.open[level].pop()
            count[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == w:
            self.close(pieces)
        else:
            self.open.setdefault(level + size, []).append(pieces)
            count[level + size] += 1
            self.n_open += 1
            if self.n_open >= self.max_open:
                self.drain(last=False)

    def drain(self, last: bool = True) -> None:
        """Close the open windows, filling the fullest with cut pieces of the emptiest."""
        order = [p for level in sorted(self.open) for p in self.open[level]]
        self.open, self.n_open = {}, 0
        self.count[:] = 0
        left, fill = [], 0
        bounds = [sum(len(p[2]) // 4 for p in pieces) for pieces in order]
        lo, hi = 0, len(order) - 1
        while lo <= hi:
            pieces, fill = order[hi], bounds[hi]
            hi -= 1
            while fill < self.window and (left or lo <= hi):
                if not left:
                    left = order[lo][::-1]
                    lo += 1
                doc, start, ids, total = left.pop()
                n = min(len(ids) // 4, self.window - fill)
                pieces.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    left.append((doc, start + n, ids[4 * n :], total))
                fill += n
            if fill == self.window:
                self.close(pieces)
            else:
                left = pieces[::-1]
        if left and not last:
            rest = left[::-1]
            fill = sum(len(p[2]) // 4 for p in rest)
            self.open[fill], self.n_open = [rest], 1
            self.count[fill] = 1
            return
        fill = sum(len(p[2]) // 4 for p in left)
        while fill:
            size = 1 << (fill.bit_length() - 1)
            pieces, room = [], size
            while room:
                doc, start, ids, total = left.pop()
                n = min(len(ids) // 4, room)
                pieces.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    left.append((doc, start + n, ids[4 * n :], total))
                room -= n
            self.close(pieces)
            fill -= size


def _pack(path: str, window: int, end_id: int, max_open: int):
    def run(batches):
        from pyspark import TaskContext

        tok = tokenizer(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        packer = Packer(window, TaskContext.get().partitionId() << 32, max_open)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                packer.place(doc, tok.encode(text.as_py() or "") + end)
            yield from _rows(packer)
        packer.drain()
        yield from _rows(packer)

    return run


def _rows(packer: Packer):
    if packer.rows:
        cols = [pa.array(c, pa.int64()) for c in zip(*packer.rows)]
        packer.rows = []
        yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 4096,
    end_id: int = 2,
    max_open: int = MAX_OPEN,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document ends with end_id. A sequence is full or has a power of two of tokens, so
    none is padded. sequence_id is the task's number times 2**32 plus a count. max_open is
    how many windows a task leaves open before it drains them.

    Null text counts as empty: one piece with end_id alone. Rows that repeat an identifier,
    or have none, are packed like others. Empty input gives no rows. Other columns are
    ignored, whatever their names.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        _pack(tokenizer_path, window, end_id, max_open), SCHEMA
    )
