"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of
labelled documents, labels every byte position and pools the position probabilities over
the whole text. Texts are laid end to end in lanes that run side by side as the rows of one
matrix; a state is carried through a text and starts anew with the next one. Only a text
over `piece` bytes is read in several lanes, each with `warm` bytes more on either side, by
which its states are settled before they count.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
GROUP_BYTES = 1 << 20  # read side by side at a time
LANES = 1024
PIECE, WARM = 1024, 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class ByteGru:
    """Weights of both directions: x (256, 3h) input table with bias, u (h, 3h) recurrent, v (2h, n) and c (n) output."""

    labels: list[str]
    hidden: int = 16
    span: int = 64
    params: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int = 7) -> "ByteGru":
        rng, h, n = np.random.default_rng(seed), self.hidden, len(self.labels)
        for d in "fb":
            self.params[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.params[f"u{d}"] = rng.normal(0, h**-0.5, (h, 3 * h)).astype(np.float32)
        self.params["v"] = rng.normal(0, 0.1, (2 * h, n)).astype(np.float32)
        self.params["c"] = np.zeros(n, np.float32)
        return self

    def _direction(self, rows: np.ndarray, d: str, keep: bool = False):
        """States (span, lanes, h) of one direction, in its own reading order; with keep also the gates."""
        h, x, u = self.hidden, self.params[f"x{d}"], self.params[f"u{d}"]
        lanes = len(rows)
        state = np.zeros((lanes, h), np.float32)
        states, gates = np.empty((self.span, lanes, h), np.float32), []
        for t in range(self.span):
            step = x[rows[:, t if d == "f" else self.span - 1 - t]]
            rec = state @ u
            zr = step[:, : 2 * h] + rec[:, : 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :h], zr[:, h:]
            n = rec[:, 2 * h :] * r
            n += step[:, 2 * h :]
            np.tanh(n, out=n)
            if keep:
                gates.append((z, r, n, rec[:, 2 * h :].copy(), state))
            state = n + z * (state - n)
            states[t] = state
        return states, gates

    def _scan(self, grid: np.ndarray, fresh: list[np.ndarray], d: str, logits: np.ndarray) -> None:
        """Adds one direction's part to logits (steps, lanes, n); fresh[t] are the lanes whose state starts anew at t."""
        h, x, u = self.hidden, self.params[f"x{d}"], self.params[f"u{d}"]
        v = self.params["v"][:h] if d == "f" else self.params["v"][h:]
        half = np.r_[np.full(2 * h, 0.5), np.ones(h)].astype(np.float32)
        # A gate is (1 + tanh(a / 2)) / 2: halved here; its other half is halved where it is used.
        x, u = x * half, u * np.r_[np.full(2 * h, 0.5), np.full(h, 0.5)].astype(np.float32)
        state = np.zeros((grid.shape[1], h), np.float32)
        both = np.empty((grid.shape[1], 2 * h), np.float32)
        for t in range(len(grid)) if d == "f" else range(len(grid) - 1, -1, -1):
            if len(fresh[t]):
                state[fresh[t]] = 0
            step = x.take(grid[t], axis=0)
            rec = state @ u
            zr = np.add(step[:, : 2 * h], rec[:, : 2 * h], out=both)  # of half the sums; the tables are halved
            np.tanh(zr, out=zr)
            zr += 1
            n = np.multiply(rec[:, 2 * h :], zr[:, h:])
            n += step[:, 2 * h :]
            np.tanh(n, out=n)
            state -= n
            state *= zr[:, :h]
            state *= 0.5
            state += n
            logits[t] += state @ v

    def pooled(self, texts: list[bytes], lanes: int = LANES, piece: int = PIECE, warm: int = WARM) -> np.ndarray:
        """Sum of the label probabilities over all positions of each text: (texts, n)."""
        cuts = []  # text, first byte read, end of those read, first that counts, end of those that count
        for i, raw in enumerate(texts):
            for s in range(0, len(raw), piece):
                e = min(len(raw), s + piece)
                cuts.append((i, max(0, s - warm), min(len(raw), e + warm), s, e))
        total = np.zeros((len(texts), len(self.labels)))
        if not cuts:
            return total
        # Longest first, each to the lane with the least so far.
        heap = [(0, lane) for lane in range(min(lanes, len(cuts)))]
        places = []
        for c in sorted(cuts, key=lambda c: c[1] - c[2]):
            at, lane = heapq.heappop(heap)
            places.append((at, lane, c))
            heapq.heappush(heap, (at + c[2] - c[1], lane))
        steps = max(at for at, _ in heap)
        grid = np.zeros((steps, len(heap)), np.uint8)
        begin, finish = [[] for _ in range(steps)], [[] for _ in range(steps)]
        for at, lane, (i, a, z, _, _) in places:
            grid[at : at + z - a, lane] = np.frombuffer(texts[i], np.uint8)[a:z]
            begin[at].append(lane)
            finish[at + z - a - 1].append(lane)
        logits = np.empty((steps, len(heap), len(self.labels)), np.float32)
        logits[:] = self.params["c"]
        for fresh, d in ((begin, "f"), (finish, "b")):
            self._scan(grid, fresh, d, logits)
        sums = np.zeros((len(self.labels), steps + 1, len(heap)))  # of the probabilities before each step, label by label
        for s in range(0, steps, 256):
            part = logits[s : s + 256].transpose(2, 0, 1).copy()
            part -= part.max(axis=0)
            np.exp(part, out=part)
            part /= part.sum(axis=0)
            np.cumsum(part, axis=1, out=sums[:, s + 1 : s + 1 + part.shape[1]])
            sums[:, s + 1 : s + 1 + part.shape[1]] += sums[:, s : s + 1]
        for at, lane, (i, a, _, s, e) in places:
            total[i] += sums[:, at + e - a, lane] - sums[:, at + s - a, lane]
        return total

    def gradients(self, rows: np.ndarray, mask: np.ndarray, want: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over masked positions and its gradients, by backpropagation through time."""
        h, span, p = self.hidden, self.span, self.params
        fwd, gf = self._direction(rows, "f", keep=True)
        bwd, gb = self._direction(rows, "b", keep=True)
        both = np.concatenate([fwd, bwd[::-1]], axis=2)
        logits = both @ p["v"] + p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        weight = (mask.T / max(1, mask.sum())).astype(np.float32)
        lane = np.arange(len(rows))
        loss = float(-(np.log(prob[:, lane, want] + 1e-9) * weight).sum())
        prob[:, lane, want] -= 1
        dl = prob * weight[:, :, None]
        grads = {"v": np.tensordot(both, dl, ([0, 1], [0, 1])), "c": dl.sum((0, 1))}
        dboth = dl @ p["v"].T
        for d, gates, ds in (("f", gf, dboth[:, :, :h]), ("b", gb, dboth[::-1, :, h:])):
            gx, gu = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"u{d}"])
            carry = np.zeros((len(rows), h), np.float32)
            for t in reversed(range(span)):
                z, r, n, rec_n, before = gates[t]
                dh = ds[t] + carry
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * rec_n * r * (1 - r)
                drec = np.concatenate([dz, dr, dn * r], axis=1)
                gu += before.T @ drec
                carry = dh * z + drec @ p[f"u{d}"].T
                np.add.at(gx, rows[:, t if d == "f" else span - 1 - t], np.concatenate([dz, dr, dn], axis=1))
            grads[f"x{d}"], grads[f"u{d}"] = gx, gu
        return loss, grads

    def fit(self, rows: np.ndarray, mask: np.ndarray, want: np.ndarray, steps: int = 400, batch: int = 256, rate: float = 0.01, seed: int = 7) -> "ByteGru":
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        s = {k: np.zeros_like(v) for k, v in self.params.items()}
        for i in range(1, steps + 1):
            pick = rng.integers(0, len(rows), min(batch, len(rows)))
            _, g = self.gradients(rows[pick], mask[pick], want[pick])
            lr = rate * (1 - i / (steps + 1)) ** 0.5
            for k in g:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.01 * (g[k] ** 2 - s[k])
                self.params[k] -= (lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return self


def segments(raw: bytes, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of span bytes, the last one padded with zeros, and the mask of real bytes."""
    n = -(-len(raw) // span)
    rows = np.zeros(n * span, np.uint8)
    rows[: len(raw)] = np.frombuffer(raw, np.uint8)
    mask = np.arange(n * span) < len(raw)
    return rows.reshape(n, span), mask.reshape(n, span)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    max_docs: int = 1500,
    max_bytes: int = 16 << 20,
    hidden: int = 16,
    steps: int = 400,
) -> ByteGru | None:
    """Fit on whole texts of at most max_docs labelled documents, those with the smallest hash.

    Of these, in order, as many are taken as have max_bytes bytes together: the bound of
    what is collected. Rows of a training batch are segments drawn from all over the
    texts. None if there is no labelled text.
    """
    labelled = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(label_col).cast("string").alias("y")).filter(
        F.col("y").isNotNull() & (F.length(F.trim("t")) > 0)
    )
    order = F.xxhash64(F.col("i").cast("string"), F.lit("train"))
    sizes = labelled.select(order.alias("o"), F.octet_length("t").alias("n")).orderBy("o", "n").limit(max_docs)
    upto, last = 0, None
    for r in sizes.collect():  # max_docs rows of two numbers
        upto += r["n"]
        if upto > max_bytes and last is not None:
            break
        last = r["o"]
    if last is None:
        return None
    rows = labelled.withColumn("o", order).filter(F.col("o") <= last).select("o", "y", "t").orderBy("o", "t").limit(max_docs).collect()
    model = ByteGru(sorted({r["y"] for r in rows}), hidden=hidden).start()
    index = {y: i for i, y in enumerate(model.labels)}
    parts = [(*segments(r["t"].encode(), model.span), index[r["y"]]) for r in rows if has_letter(r["t"])]
    if not parts:
        return None
    want = np.concatenate([np.full(len(a), y) for a, _, y in parts])
    return model.fit(np.concatenate([a for a, _, _ in parts]), np.concatenate([b for _, b, _ in parts]), want, steps=steps)


def _score(model: ByteGru | None):
    def run(batches):
        for b in batches:
            n = b.num_rows
            labels = model.labels if model else []
            mean, known = np.zeros((n, max(1, len(labels)))), np.zeros(n, bool)
            held, at, size = [], [], 0
            for i, t in enumerate(b.column(1)):
                text = t.as_py()
                known[i] = model is not None and has_letter(text)
                if known[i]:
                    held.append(text.encode())
                    at.append(i)
                    size += len(held[-1])
                if size >= GROUP_BYTES:
                    mean[at] = model.pooled(held) / np.array([[len(x)] for x in held])
                    held, at, size = [], [], 0
            if held:
                mean[at] = model.pooled(held) / np.array([[len(x)] for x in held])
            best = mean.argmax(axis=1)
            pred = [labels[k] if ok else UNKNOWN for k, ok in zip(best, known)]
            score = np.where(known, np.clip(mean[np.arange(n), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: ByteGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (mean probability of lang_pred over all positions).

    Null texts, and texts without a letter, are `und` with score 0, as is everything where
    nothing could be learned. Repeated rows and null identifiers are answered one by one;
    empty input gives no rows. Other columns are ignored, whatever their names.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        _score(model), "doc_id long, lang_pred string, score double"
    )


def held_out(id_col: str, folds: int, fold: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def keep_known(docs: DataFrame, model: ByteGru | None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs without those of no known language: `und`, or a score under `least`.

    The answer travels in the same Arrow pass as the rows, so repeated identifiers, or none,
    stay apart and equal rows stay or go together. Null and empty texts go, and so does
    everything where nothing could be learned. Columns are those of docs, whatever their names.
    """
    scorer = _score(model)

    def run(batches):
        for b in batches:
            small = pa.RecordBatch.from_arrays([b.column(id_at), b.column(text_at)], names=["i", "t"])
            for out in scorer([small]):
                ok = (out.column(1).to_numpy(zero_copy_only=False) != UNKNOWN) & (out.column(2).to_numpy() >= least)
                yield b.filter(pa.array(ok.astype(bool)))

    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)
