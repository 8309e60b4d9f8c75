"""The kernel of the nearest neighbours against the plan in plain joins."""

import random

import pytest

from braidwork.functions.text import spaced_key
from braidwork.operators import blocking


def shown(df):
    return {(r["left_id"], r["right_id"], round(r["cosine"], 9), r["seq"]) for r in df.collect()}


@pytest.fixture
def sides(spark):
    rng = random.Random(4)
    words = ["red", "bolt", "brand", "vol", "größe", "7", "12", "x", "a", "desk　top", "a\x1cb"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
    left = [(i, text()) for i in range(80)] + [(80 + i, "red bolt") for i in range(9)] + [(95, None)]
    right = [(i, text() + rng.choice(["", "q", " q", "\t\tx"])) for i in range(60)] + [(60, None), (61, "zzzz"), (62, "red bolt"), (63, "a  b" * 300)]
    return spark.createDataFrame(left, "left_id int, key string"), spark.createDataFrame(right, "right_id int, key string")


@pytest.mark.parametrize("k", [1, 5, 200])
def test_matrix_and_sums(spark, sides, monkeypatch, k):
    left, right = sides
    expected = shown(blocking.nearest_native(left, right, k))
    assert shown(blocking.nearest_neighbours(left, right, k)) == expected
    monkeypatch.setattr(blocking, "CELLS", 40)  # many narrow matrices
    assert shown(blocking.nearest_neighbours(left, right, k)) == expected
    monkeypatch.setattr(blocking, "DENSE", 0)  # sums of weights
    monkeypatch.setattr(blocking, "TABLE", 0)  # and grams found by sorting
    assert shown(blocking.nearest_neighbours(left, right, k)) == expected


def test_joins_of_bounded_size(spark, sides, monkeypatch):
    left, right = sides
    expected = shown(blocking.nearest_native(left, right, 5))
    assert shown(blocking.nearest_joined(left, right, 5)) == expected
    monkeypatch.setattr(blocking, "JOINED", 10)
    monkeypatch.setattr(blocking, "nearest_native", lambda *a: pytest.fail("joined"))
    assert shown(blocking.nearest_joined(left, right, 5)) == expected


def test_equal_keys_are_compared_once(spark, sides, monkeypatch):
    left, right = sides
    sent = []
    real = blocking._packed
    monkeypatch.setattr(blocking, "_packed", lambda keys, *rest: sent.append(keys) or real(keys, *rest))
    blocking.nearest_neighbours(left, right, 3)
    assert len(sent) == 1 and sorted(sent[0]) == sorted({r["key"] or "" for r in left.collect()})


def test_spaced_key_of_odd_texts(spark):
    texts = ["  A--b  C ", "É　x\n\ny", "", None, "\U0001f600\U0001f600z", "...", "a\tb"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(spaced_key("t")).collect()]
    assert got == ["a b c", "x y", "", None, "z", "", "a b"]
