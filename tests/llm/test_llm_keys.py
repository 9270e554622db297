"""Rows that share an identifier, or have none, are told apart by their texts."""

import pytest

from tessera.llm import decontaminate, simhash

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(i):
    return " ".join(f"{w}{i}" for w in WORDS)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, text(1)), (2, text(1)), (2, text(2)), (3, text(3)), (3, text(4)), (4, text(5)), (4, text(5)),
        (None, text(1)), (None, text(6)), (None, text(7)), (None, text(7)),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def left(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_near_copies_keep_each_text_of_an_identifier(docs):
    want = [(1, text(1)), (2, text(2)), (3, text(3)), (3, text(4)), (4, text(5)), (None, text(6)), (None, text(7))]
    assert left(simhash.drop_near_copies(docs)) == sorted(want, key=str)


def test_near_copies_within_one_identifier_leave_one(spark):
    rows = [(5, text(1)), (5, text(1).upper()), (None, text(2)), (None, text(2).upper())]
    got = left(simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(i, t.lower()) for i, t in got] == [(5, text(1)), (None, text(2))]


def test_contaminated_rows_take_no_other_text_along(spark, docs):
    bench = spark.createDataFrame([(1, text(2)), (2, text(6)), (3, text(3))], "item_id long, text string")
    want = [(1, text(1)), (2, text(1)), (3, text(4)), (4, text(5)), (4, text(5)), (None, text(1)), (None, text(7)), (None, text(7))]
    for few in (100_000, 0):
        assert left(decontaminate.drop_contaminated(docs, bench, broadcast_rows=few)) == sorted(want, key=str)
