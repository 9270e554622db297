"""Toxicity by noisy-channel deobfuscation.

Words disguised by look-alike characters, by spacing or by repeated letters become a small
lattice of letters; Viterbi decoding under a character language model picks the most likely
reading, and the restored text is scored. The language model counts letter 4-grams over
all documents. A word is known by itself and by its first letters, so a stem with an ending
never seen still counts. These weights and the numbers of the classifier are fitted on a
bounded sample of labelled documents.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIXES = (4, 5, 6)
LETTERS = 27  # a-z, and 0 for whatever ends a word
ORDER = 4
GRAMS = LETTERS**ORDER
CACHE = 150_000
SETTLE, HOLD = 512, 1 << 14  # steps after which the paths that are left are looked at for a common beginning; most steps held
FADE = 0.7  # weight of each further word after the second, against the one before
#: Which letters a character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
    "а": "a", "в": "b", "е": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
#: Log-probabilities of the channel: a look-alike for a letter, a mark left as it is, one more copy of a letter, a gap put in.
DISGUISE, MARK, COPY, GAP = -1.5, -4.0, -0.7, -2.0

WORDS = re.compile(r"[^\W\d_]+")
LATTICE = "a-z0-9" + "".join(re.escape(c) for c in LOOKALIKES if not c.isdigit())
RUN = re.compile(rf"[{LATTICE}]+")
JOINED = re.compile(rf"[{LATTICE}]+(?:(?:(?![{LATTICE}])[\W_])+[{LATTICE}]+)+")
DISGUISED = re.compile(r"(?=.*[a-z])(?=.*[^a-z]).{3,}|.*([a-z])\1.*")
SPACED = re.compile(r"(?<!\S)(?:[a-z0-9@$!|+][.,;:_*~-]*[ \t]+){2,}[a-z0-9@$!|+](?![^\s.,;:?!])")
SAME = re.compile(r"(.)\1{16,}")
SUSPECT = re.compile(rf"([a-z])\1|[{''.join(c for c in LOOKALIKES if c.isalpha())}]")
TRIM = ".,;:?!\"'()[]{}"


def letter_codes() -> np.ndarray:
    codes = np.zeros(256, np.int64)
    for i in range(26):
        codes[97 + i] = codes[65 + i] = i + 1
    return codes


def _count(batches):
    """Letter 4-gram counts of what one task reads, over runs of about a megabyte."""
    codes, total, held, size = letter_codes(), np.zeros(GRAMS, np.int64), [], 0

    def add():
        c = codes[np.frombuffer(b"   " + b"   ".join(held) + b"   ", np.uint8)]
        if len(c) >= ORDER:
            g = ((c[:-3] * LETTERS + c[1:-2]) * LETTERS + c[2:-1]) * LETTERS + c[3:]
            total[:] += np.bincount(g, minlength=GRAMS)
        held.clear()

    for b in batches:
        for t in b.column(0):
            if t.is_valid:
                held.append(t.as_buffer().to_pybytes())
                size += len(held[-1])
                if size > 1 << 20:
                    add()
                    size = 0
    add()
    seen = np.flatnonzero(total)
    for i in range(0, len(seen), 50_000):
        part = seen[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["gram", "n"])


def letter_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(letter | three letters before), flat, from the counts over every text; at most 27**4 rows reach the driver."""
    counts = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(_count, "gram int, n long")
    n = np.zeros(GRAMS)
    for r in counts.groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        n[r["gram"]] = r["n"]
    four = n.reshape((LETTERS,) * 4)
    p = np.full(four.shape, 0.05 / LETTERS)
    for axes, weight in (((), 0.6), ((0,), 0.25), ((0, 1), 0.1)):
        part = four.sum(axis=axes, keepdims=True) if axes else four
        p = p + weight * (part + 1e-6) / (part.sum(axis=3, keepdims=True) + 1e-6 * LETTERS)
    return np.log(p).astype(np.float32).ravel()


def _option(c: str, spaced: bool) -> list[tuple[str, float]]:
    if "a" <= c <= "z":
        return [(c, 0.0)]
    if c in LOOKALIKES:
        return [(x, DISGUISE) for x in LOOKALIKES[c]] + [(" ", MARK)]
    return [("", 0.0), (" ", GAP)] if spaced else [(" ", 0.0)]


_OPTIONS = {spaced: {c: _option(c, spaced) for c in [*map(chr, range(128)), *LOOKALIKES]} for spaced in (False, True)}


def options(chars: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """The lattice: what each character may be read as, with its log-probability; '' drops it, ' ' ends a word."""
    known = _OPTIONS[spaced]
    return [known[c] if c in known else _option(c, spaced) for c in chars]


def _path(trail: list[dict], state: int) -> tuple[int, list[str]]:
    """The state before the trail on the way to `state`, and the letters put out since."""
    out = []
    for came in reversed(trail):
        state, letter = came[state]
        out.append(letter)
    return state, out[::-1]


def decode(chars: str, model: array, spaced: bool = False) -> str:
    """The most likely reading of a disguised string, exactly: Viterbi over the last three letters, with back-pointers.

    What all paths that are left have in common is put out from time to time; where they
    stay apart for HOLD steps, the best one is followed. So the memory of a long string is
    bounded. A character that repeats over 16 times counts as 16 copies.
    """
    best, trail, done, look = {0: 0.0}, [], [], SETTLE
    chars = SAME.sub(lambda m: m[1] * 16, chars)
    top = LETTERS ** (ORDER - 1)
    for choice in options(chars, spaced):
        if len(best) == 1:
            state = next(iter(best))
            if trail:
                done += _path(trail, state)[1]
                trail, look = [], SETTLE
            if len(choice) == 1 and choice[0][0]:  # one path, one way on: no score is needed
                letter = choice[0][0]
                d = ord(letter) - 96 if letter != " " else 0
                if not d or d != state % LETTERS:
                    done.append(letter)
                    best = {(state * LETTERS + d) % top: 0.0}
                    continue
        nxt: dict[int, float] = {}
        came: dict[int, tuple[int, str]] = {}
        for state, score in best.items():
            for letter, cost in choice:
                if not letter:
                    moves = ((state, score + cost, ""),)
                else:
                    d = ord(letter) - 96 if letter != " " else 0
                    at = state * LETTERS + d
                    moves = ((at % top, score + cost + model[at], letter),)
                    if d and d == state % LETTERS:
                        moves += ((state, score + cost + COPY, ""),)
                for to, s, put in moves:
                    if to not in nxt or nxt[to] < s:
                        nxt[to] = s
                        came[to] = (state, put)
        best = nxt
        trail.append(came)
        if len(trail) >= HOLD:
            state = max(best, key=lambda x: (best[x], x))
            done += _path(trail, state)[1]
            best, trail, look = {state: 0.0}, [], SETTLE
        elif len(trail) >= look:
            done += _settled(trail, best)
            look = max(SETTLE, 2 * len(trail))
    state = max(best, key=lambda x: (best[x] + model[x * LETTERS], x))
    return "".join(done + _path(trail, state)[1])


def _settled(trail: list[dict], best: dict) -> list[str]:
    """Takes from the trail, and returns, the letters of the steps before all paths part."""
    live = set(best)
    for i in range(len(trail) - 1, -1, -1):
        live = {trail[i][x][0] for x in live}
        if len(live) == 1:
            out = _path(trail[:i], next(iter(live)))[1]
            del trail[:i]
            return out
    return []


def features(word: str) -> list[str]:
    """A word and its prefixes, these marked with a dash."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)]


class Restorer:
    """Words of a text, as written and as restored; what `use` makes of each is kept by chunk."""

    def __init__(self, model: np.ndarray, use=lambda words: words):
        self.model, self.use = array("f", model.tobytes()), use
        self.cache: dict[str, tuple] = {}

    def chunk(self, chunk: str) -> tuple:
        if len(self.cache) >= CACHE:
            self.cache.clear()
        core = chunk.strip(TRIM)
        if core.isalpha() and not SUSPECT.search(core):  # a plain word and nothing else
            words = [core]
        else:
            words = WORDS.findall(chunk)
            for run in RUN.findall(chunk):
                run = run.lstrip("(").rstrip("!(")
                if DISGUISED.fullmatch(run):
                    words += decode(run, self.model).split()
            for run in JOINED.findall(chunk):
                run = run.lstrip("(").rstrip("!(")
                if len(run) > 4:
                    words += decode(run, self.model, spaced=True).split()
            words = dict.fromkeys(words)
        found = self.cache[chunk] = tuple(self.use(words))
        return found

    def spaced(self, text: str, singles: int) -> list:
        if singles < 3:
            return []
        return list(self.use([w for m in SPACED.finditer(text) for w in decode(m[0], self.model, spaced=True).split()]))

    def words(self, text: str) -> set:
        low = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()  # full-width letters and the like
        chunks = low.split()
        found, known = set(), self.cache
        for c in set(chunks):
            made = known.get(c)
            if made is None:
                made = self.chunk(c)
            if made:
                found.update(made)
        short = [c for c in chunks if len(c) < 4]
        return found.union(self.spaced(low, sum(len(c.strip(TRIM)) == 1 for c in short)))


@dataclass
class ToxicityModel:
    letters: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    coef: np.ndarray = field(default_factory=lambda: np.array([-4.0, 1.0, 0.0, 0.0]))
    heads: frozenset[str] = frozenset()

    def weigh(self, weights: dict[str, float]) -> None:
        """Sets the weights; heads are the beginnings that a word with a weight can have."""
        self.weights, self.heads = weights, frozenset(f.rstrip("-")[: PREFIXES[0]] for f in weights)

    def rated(self, words) -> list[tuple[float, str]]:
        """The words that have a weight, each with that of its strongest feature."""
        out = []
        for w in words:
            if w[: PREFIXES[0]] in self.heads:
                best = max(self.weights.get(f, 0.0) for f in features(w))
                if best > 0:
                    out.append((best, w))
        return out

    def restorer(self) -> Restorer:
        return Restorer(self.letters, self.rated)

    def evidence(self, text: str | None, restorer: Restorer) -> tuple[float, float, float]:
        """Strongest, second strongest and the fading sum of all other word weights; zeros for null."""
        if not text or not self.weights:
            return 0.0, 0.0, 0.0
        top = sorted((x for x, _ in restorer.words(text)), reverse=True) + [0.0, 0.0]
        return top[0], top[1], sum(x * FADE**i for i, x in enumerate(top[2:]))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.coef[0] + evidence @ self.coef[1:], -30, 30)))


def _sampled_words(letters: np.ndarray):
    def run(batches):
        restorer = Restorer(letters, lambda words: [f for w in words for f in features(w)])
        for b in batches:
            words = [sorted(restorer.words(t or "")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], names=["y", "words"])

    return run


def _evidence(model: ToxicityModel):
    def run(batches):
        restorer = model.restorer()
        for b in batches:
            found = [model.evidence(t.as_py(), restorer) for t in b.column(1)]
            cols = [pa.array(np.array(c, float)) for c in zip(*found)] if found else [pa.array([], pa.float64())] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["k", "e0", "e1", "e2"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method; a bias first, then one coefficient a column."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * np.r_[0, w[1:]]
        hess = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_docs: int = 12_000,
    lexicon: int = 5_000,
    least_z: float = 3.5,
    least_docs: int = 3,
) -> ToxicityModel:
    """Letter model over all docs; word weights and classifier on at most max_docs labelled ones (smallest hash first).

    A feature's weight is its smoothed log-odds; features with a z-score under least_z, or in
    fewer than least_docs toxic documents, have none, and `lexicon` of them are kept at most.
    """
    model = ToxicityModel(letter_model(docs, text_col))
    own = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    marks = labels.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y")).dropna()
    marks = marks.groupBy("k").agg(F.max("y").alias("y")).join(own.select("k").distinct(), "k", "left_semi")
    chosen = marks.orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(max_docs)
    sample = own.join(F.broadcast(chosen), "k").select("y", "t")
    words = sample.mapInArrow(_sampled_words(model.letters), "y int, words array<string>")
    counts = words.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    sizes = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return model
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (toxic + 1.0 - a)) - F.log(b / (clean + 1.0 - b))
    rated = counts.filter(F.col("a") >= least_docs).select("w", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))
    rated = rated.filter(F.col("z") >= least_z).orderBy(F.desc("z"), "w").limit(lexicon)
    model.weigh({r["w"]: float(r["odds"]) for r in rated.collect()})
    seen = sample.select(F.col("y").cast("long").alias("y"), "t").mapInArrow(_evidence(model), "k long, e0 double, e1 double, e2 double").toPandas()
    model.coef = logistic(seen[["e0", "e1", "e2"]].to_numpy(), seen["k"].to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, score in [0, 1], predicted (1 if score >= cut).

    Null and empty texts have no evidence and so the lowest score. Repeated rows and null
    identifiers are scored one by one; without both kinds of labels every score is the same
    low one. Empty input gives no rows. Other columns are ignored, whatever their names.
    """

    def run(batches):
        for b in _evidence(model)(batches):
            s = model.score(np.column_stack([b.column(i).to_numpy() for i in (1, 2, 3)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, score double, predicted int")
