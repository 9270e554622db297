import uuid

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import query as Q
from tessera.functions import similarity as S
from tessera.functions import text as X


@pytest.mark.parametrize(
    "given,normalized",
    [("  “NASA” GPU systems — C++  ", "nasa gpu systems - c++"), ("GPU / CPU   v2", "gpu/cpu v2"), ("C++ Controller", "c++ controller"), ("The a power unit", "power unit"), ("", "")],
)
def test_normalize(given, normalized):
    assert X.normalize_text(given)[0] == normalized


def test_display_keeps_case():
    assert X.normalize_text("  “NASA” GPU systems — C++  ")[1] == "NASA GPU systems - C++"


def test_clean_text():
    got = X.clean_text("CONFIDENTIAL - internal use only\nBody text\n-----\n12\nCopyright 2020 X\n```\nDRAFT code\n```\nvalue 2 O 5 ok")
    assert "CONFIDENTIAL" not in got and "-----" not in got and "Copyright" not in got
    assert "DRAFT code" in got and "Body text" in got
    assert X.clean_text("value 2 O 5 and 3 l 4 `1`") == "value 2 0 5 and 3 1 4 `1`"


def test_string_similarity():
    assert S.ratio("power subsystem", "power sub-system") == pytest.approx(200 * 15 / 31)
    assert S.weighted_ratio("power subsystem", "power sub-system") >= 90
    assert S.ratio("EPS", "EPC") < 96
    assert S.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert S.weighted_ratio("", "x") == 0


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_bit_parallel_lcs():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 70))) for _ in "ab")
        assert S.lcs(a, b) == slow_lcs(a, b)


def test_keys(spark):
    df = spark.createDataFrame([("AC Motor",), ("AC_Motor",), ("  AC motor  ",)], "n string")
    got = df.select(schemas.key_fragment(X.normalize_name("n")).alias("k"), schemas.uuid5(F.col("n")).alias("u"), "n").collect()
    assert {r["k"] for r in got} == {"ac_motor"}
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"])) for r in got)


def test_thresholds(spark):
    df = spark.createDataFrame([("eps", "epc"), ("short", "shorts"), ("a longer name", "another name"), ("", "x")], "a string, b string")
    got = [r[0] for r in df.select(S.fuzzy_threshold(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([0.96, 0.92, 0.9, 1.0])


def test_questions(spark):
    asked = ["How to perform the startup procedure?", "System power", "What components depend on the bus?", "Compare all within 2 hops in document alpha"]
    q = Q.parse(spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")).orderBy("query_id").collect()
    assert q[0]["intent"] == "procedural" and q[0]["strategy"] == "graph_first" and q[0]["is_complex"]
    assert q[1]["intent_confidence"] <= 0.7 and q[1]["expanded_terms"]["power"] == ["electrical", "energy"]
    assert q[2]["relationship_types"] == ["DEPENDS_ON"] and q[2]["requires_graph_traversal"]
    assert q[3]["max_depth"] == 2 and ("document_id", "document", "alpha") in [tuple(c) for c in q[3]["constraints"]]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(S.cosine(F.col("a"), F.col("b")), S.l2_normalize(F.col("a"))).collect()
    assert [r[0] for r in got] == pytest.approx([1, 0, 0]) and got[0][1] == pytest.approx([0.6, 0.8]) and got[1][1] == [0, 0]
