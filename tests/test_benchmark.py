"""The benchmark generator against the same rules in plain Python."""

import hashlib
import re

import pytest

from braidwork.operators import benchmark as G
from braidwork.operators.blocking import Refused

TITLES = ["Atlas of the North: maps and tables", "Tea", "First Light (second print)", "a", "Night & Day, vol. 2", "The Sea and the Shore", "One  two   three", "[...]", "Über-Räume, 3"]


def u(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def changed(title, key, seed=0):
    order = sorted((u(seed, f"op{i}", key), i) for i in range(5))
    many, out = 1 + int(u(seed, "many", key) * 3), title
    for _, op in order[:many]:
        words = out.split()
        if op == 0:
            out = re.split(r"[:(\[]", out)[0].strip(" ")
        elif op == 1:
            out = " ".join([words[1], words[0], *words[2:]] if len(words) > 1 else words)
        elif op == 2 and len(out) >= 4:
            at = 1 + int(u(seed, "where", key) * (len(out) - 2))
            out = out[:at] + (out[at + 1 :] if u(seed, "which", key) < 0.5 else out[at + 1 : at + 2] + out[at] + out[at + 2 :])
        elif op == 3:
            out = " ".join(G.ABBREVIATIONS.get(w.lower(), w) for w in words)
        elif op == 4:
            out = re.sub(r"[^\w\s]", "", out)
    return out.strip(" ") or title


def test_make(spark):
    n = 90
    rows = [(f"k{i}", TITLES[i % len(TITLES)], "abc"[i % 3], 10.0 + i) for i in range(n)]
    catalogue = spark.createDataFrame(rows, "upc string, title string, category string, price double")
    left, right, truth = (df.collect() for df in G.make(catalogue, ["a", "b", "c"], 5))
    order = sorted(rows, key=lambda r: hashlib.md5(f"5|part|{r[0]}".encode()).hexdigest())
    shared, only_left, only_right = order[:54], order[54:76], order[76:]
    assert {r["left_id"] for r in left} == {r[0] for r in shared + only_left} and len(right) == len(shared + only_right)
    dealt = sorted(shared + only_right, key=lambda r: hashlib.md5(f"5|order|{r[0]}".encode()).hexdigest())
    ids = {r[0]: f"R{i:04d}" for i, r in enumerate(dealt)}
    assert {(r["left_id"], r["right_id"]) for r in truth} == {(r[0], ids[r[0]]) for r in shared}
    by_id = {r["right_id"]: r for r in right}
    for key, title, category, price in dealt:
        got, roll = by_id[ids[key]], u(5, "category", key)
        assert got["title"] == changed(title, key, 5)
        expected = "" if roll < 0.1 else "abc"[int(u(5, "pick", key) * 3)] if roll < 0.2 else category
        assert got["category"] == expected
        moved = price * (1 + u(5, "shift", key) * 0.3 - 0.15) if u(5, "price", key) < 0.6 else price
        assert got["price"] == pytest.approx(moved, abs=0.006) and abs(got["price"] / price - 1) < 0.151
    with pytest.raises(Refused):
        G.make(catalogue.union(catalogue.limit(1)), ["a"])
