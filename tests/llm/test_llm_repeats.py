import hashlib
import random

import pytest

from tessera.llm.repeats import remove_repeats


def brute(rows, length):
    """rows (doc_id, text) -> {doc_id: (n_bytes, n_removed, n_spans, sha)}"""
    seen, out = set(), {}
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[k] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(10, 60)) for _ in range(6)]
    line = text(22)
    rows = []
    for i in range(160):
        parts = [text(rng.randint(0, 30))]
        if i % 3:
            parts.append(line)
        if rng.random() < 0.5:
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            parts += [p[a : a + rng.randint(90, 260)], text(5)]
        if rng.random() < 0.1:
            parts = parts * 2
        rows.append((i, " ".join(parts)))
    rows += [(1000 + i, rows[i * 7][1]) for i in range(12)]
    rows += [(2000, None), (2001, ""), (2002, "a" * 400), (2003, "ab" * 150), (2004, "x" * 99), (2005, rows[5][1][:99]), (None, rows[9][1])]
    return rows


@pytest.mark.parametrize("seed,length,hot,bits", [(1, 100, None, 1 << 16), (2, 100, 20, 1 << 16), (3, 40, None, 64), (4, 40, 15, 64)])
def test_same_as_brute_force(spark, seed, length, hot, bits):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in remove_repeats(df, length=length, hot_rows=hot, bloom_bits=bits).collect()}
    assert got == brute(rows, length)


def test_repeated_rows_are_one_document(spark):
    t = "one two three four five six seven eight nine ten " * 1
    rows = [(1, t * 1 + "x" * 200), (1, t * 1 + "x" * 200), (2, t * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in remove_repeats(df).collect())
    want = brute([rows[0], rows[2]], 100)
    assert got == sorted([(1, *want[1])] * 2 + [(2, *want[2])])


def test_empty(spark):
    df = spark.createDataFrame([], "k string, doc_id long, text string, h long")
    assert remove_repeats(df).count() == 0
