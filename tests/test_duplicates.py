"""Name duplicates against all pairs."""

import random
from difflib import SequenceMatcher

from tessera.functions import similarity as S
from tessera.operators import curation as U
from tessera.operators import discovery as D


def test_every_alike_pair_of_names_is_found(spark):
    rng = random.Random(9)
    names = {"", "a", "ab", "ba", "the motor", "motor, the", "motor", "éa", "aé"}
    names |= {"".join(rng.choice("abc ") for _ in range(rng.randint(1, 14))) for _ in range(150)}
    for base in ("reaction wheel assembly", "star tracker", "solar array drive motor"):
        for _ in range(25):
            t = list(base)
            for _ in range(rng.randint(1, 8)):
                t.insert(rng.randrange(len(t) + 1), rng.choice("xyz")) if rng.random() < 0.5 else t.pop(rng.randrange(len(t)))
            names.add("".join(t))
    # Lengths of 17 together, and no two equal letters in a row in common.
    names |= {"abcdefgh", "a1b2c3d4e", "axbxcxdx", "abcdxxxx"}
    got = {(r["ln"], r["rn"]): round(r["score"], 9) for r in U.similar_names(spark.createDataFrame([(n,) for n in names], "n string")).collect()}
    every = {(a, b): SequenceMatcher(None, a, b).ratio() for a in names for b in names}
    assert got == {p: round(s, 9) for p, s in every.items() if s > 0.7}


def test_duplicates_across_types_and_first_letters(spark):
    rng = random.Random(3)
    base = ["reaction wheel", "eaction wheel", "the reaction wheel", "star tracker", "tsar tracker", "bus"]
    rows = [(f"k{i:02d}", rng.choice(base), rng.choice("XY"), [rng.choice(["rw", "bus", "st", "q"])] if rng.random() < 0.3 else []) for i in range(60)]
    want = {}
    for k, n, _, al in rows:
        found = []
        for o, m, _, bl in rows:
            score = max([1.0 if set(al) & set(bl) else 0.0, 0.9 if n in bl or m in al else 0.0, s if (s := SequenceMatcher(None, n, m).ratio()) > 0.7 else 0.0])
            if o != k and score:
                found.append((-round(score, 9), o))
        want |= {(k, o): (-s, i) for i, (s, o) in enumerate(sorted(found)[:5], 1)}
    c = spark.createDataFrame(rows, "candidate_key string, canonical_name string, candidate_type string, aliases array<string>")
    assert {(r["left"], r["right"]): (round(r["score"], 9), r["rank"]) for r in U.duplicates(c).collect()} == want


def test_choices_of_any_first_letter(spark):
    names = ["motor unit", "otor unit", "rotor unit", "unit motor", "wheel"]
    df = spark.createDataFrame([(n, "XY"[i % 2]) for i, n in enumerate(names)], "name string, entity_type string")
    got = {(r["source"], r["rank"]): r["choice"] for r in D.top_choices(df, df).collect()}
    want = {(a, i): b for a in names for i, b in enumerate(sorted(names, key=lambda b: (-S.weighted_ratio(a, b), b))[:3], 1)}
    assert got == want
