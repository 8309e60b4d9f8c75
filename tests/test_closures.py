"""Closures and sweeps against plain versions; pairs inside entities are counted, never made."""

from itertools import combinations

import numpy as np
import pytest

from braidwork.operators import entities, experiments, model


def closed(records, edges):
    root = {r: r for r in records}
    for _ in records:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_audit_counts(spark, monkeypatch):
    monkeypatch.setattr(entities, "inner_pairs", lambda *a: pytest.fail("pairs were made"))
    rng = np.random.default_rng(11)
    records = [f"L{i:02d}" for i in range(30)] + [f"R{i:02d}" for i in range(30)]
    scored = {(f"L{a:02d}", f"R{b:02d}"): float(np.round(rng.random(), 3)) for a, b in rng.integers(0, 30, (70, 2))}
    accepted = [p for p, s in scored.items() if s >= 0.6] + [("L00", "R29")]  # one that nobody scored
    truth = [(f"L{i:02d}", f"R{i:02d}") for i in range(20)]
    root, true = closed(records, accepted), closed(records, truth)
    expected = {}
    for a, b in combinations(records, 2):
        if root[a] == root[b]:
            kind = "accepted by the matcher" if (a, b) in accepted else "scored, below the bar" if (a, b) in scored else "never a candidate"
            expected.setdefault(kind, []).append((true[a] == true[b], a[0] == b[0], scored.get((a, b)) if kind.startswith("scored") else None))
    frame = lambda d: spark.createDataFrame(list(d.items()), "record_id string, entity string")
    sources = spark.createDataFrame([(r, r[0]) for r in records], "record_id string, source string")
    pairs = spark.createDataFrame([(*p, s) for p, s in scored.items()] + [("L01", "R01", None)], "left_id string, right_id string, score double").dropDuplicates(["left_id", "right_id"])
    ids = spark.createDataFrame(accepted, "left_id string, right_id string")
    got = {r["bucket"]: r for r in entities.closure_audit(frame(root), ids, pairs, frame(true), sources).collect()}
    assert set(got) == set(expected) and len(got) == 3
    for kind, rows in expected.items():
        scores = [s for *_, s in rows if s is not None]
        r = got[kind]
        assert (r["pairs"], r["correct"], r["same_source"]) == (len(rows), sum(c for c, _, _ in rows), sum(s for _, s, _ in rows))
        assert (r["low"], r["high"]) == ((min(scores), max(scores)) if scores else (None, None))
        assert r["mean"] == (pytest.approx(np.mean(scores)) if scores else None)
    lone = entities.closure_audit(frame({r: r for r in records}), ids.limit(0), pairs, frame(true), sources)
    assert lone.count() == 0

def test_sweep_of_one_score(spark):
    """Scores that are the same in all splits: decided and closed once, as if in each of them."""
    rng = np.random.default_rng(12)
    rows = [(f"L{a:02d}", f"R{b:02d}", i, float(np.round(rng.random(), 2)), int(a == b)) for b in range(40) for i, a in enumerate(rng.permutation(40)[:4])]
    pairs = spark.createDataFrame(rows, "left_id string, right_id string, seq int, score double, is_match int")
    records = spark.createDataFrame([(f"{s}{i:02d}",) for s in "LR" for i in range(40)], "record_id string")
    truth = spark.createDataFrame([(f"L{i:02d}", f"R{i:02d}") for i in range(30)], "left_id string, right_id string")
    plain = experiments.sweep(model.splits(pairs, [3, 4, "x"]), records, truth, 0.6)
    once = experiments.sweep_scored(pairs, [3, 4, "x"], records, truth, 0.6)
    assert once.columns == plain.columns
    shown = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert shown(once) == shown(plain) and once.count() == 9
