import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.functions.text import spaced_key
from braidwork.operators import blocking, entities, experiments, metrics, model
from braidwork.operators.blocking import Refused
from braidwork.operators.components import components
from braidwork.operators.containment import contained
from braidwork.operators.policy import POLICIES, policy


def sides(spark):
    left = spark.createDataFrame([("a1", "Copper Kettle"), ("a2", "Walnut Desk"), ("a3", "Lamp")], "left_id string, title string")
    right = spark.createDataFrame([("b1", "Coper Kettle"), ("b2", "walnut  desk"), ("b3", "")], "right_id string, title string")
    key = lambda df: df.withColumn("key", spaced_key("title"))
    return key(left), key(right)


def test_blocking(spark, monkeypatch):
    left, right = sides(spark)
    assert {tuple(r) for r in blocking.exact_key_pairs(left, right).collect()} == {("a2", "b2")}
    shown = lambda df: {(r["left_id"], r["right_id"], round(r["cosine"], 9), r["seq"]) for r in df.collect()}
    for k in (1, 2, 5):
        rows = blocking.nearest_neighbours(left, right, k)
        assert rows.count() == min(k, 3) * 3 and shown(rows) == shown(blocking.nearest_native(left, right, k))
    best = {(r["left_id"], r["right_id"]) for r in blocking.nearest_neighbours(left, right, 1).collect()}
    assert {("a1", "b1"), ("a2", "b2")} <= best
    whole = shown(blocking.nearest_neighbours(left, right, 2))
    monkeypatch.setattr(blocking, "LONG", 1)  # as do runs that are added by themselves
    assert shown(blocking.nearest_neighbours(left, right, 2)) == whole
    monkeypatch.setattr(blocking, "ENTRIES", 20)  # and several blocks
    assert shown(blocking.nearest_neighbours(left, right, 2)) == whole
    with pytest.raises(Refused):
        blocking.nearest_neighbours(left, right, 0)


def test_coverage_of_nothing(spark):
    none = spark.createDataFrame([], "left_id string, right_id string")
    one = spark.createDataFrame([("a1", "b1")], "left_id string, right_id string")
    row = blocking.coverage(none, one, 8).first()
    assert row["recall"] == 0.0 and row["reduction"] == 1.0


def test_contained(spark):
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 40, n))
    texts = [words(60) for _ in range(40)] + [None, "", "x"]
    items = [texts[i][5:60] for i in range(0, 40, 4)] + [texts[3], "w1", "w1 w2", "x", "no such words in any text", None, texts[5][7:40] + "\n"]
    a = spark.createDataFrame(list(enumerate(items)), "item_id int, item string")
    b = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {tuple(r) for r in contained(a, b).collect()}
    assert got == {(i, j) for i, x in enumerate(items) for j, t in enumerate(texts) if x is not None and t is not None and x in t}
    assert contained(a, b.limit(0)).count() == 0 and contained(a.limit(0), b).count() == 0


def test_policies(spark):
    pairs = [("a1", "b1"), ("a2", "b1"), ("a1", "b2"), ("a3", "b2")]
    def keep(name, scores, threshold=0.5):
        df = spark.createDataFrame([(*p, s, 1) for p, s in zip(pairs, scores)], "left_id string, right_id string, score double, seq int")
        got = {(r["left_id"], r["right_id"]): r["keep"] for r in POLICIES[name](df, threshold).collect()}
        return [got[p] for p in pairs]
    scores = [0.85, 0.30, 0.80, 0.60]
    assert keep("threshold only", scores) == [True, False, True, True]
    assert keep("best per right", scores) == [True, False, True, False]
    assert keep("mutual best", scores) == [True, False, False, False]
    assert keep("mutual best", [0.45, 0.30, 0.40, 0.70]) == [False, False, False, True]
    assert keep("best per right", scores, float("-inf")) == [True, False, True, False]
    with pytest.raises(Refused):
        policy("none such")


def test_components_and_entities(spark):
    chain = [(i, i + 1) for i in range(64)] + [(100, 101), (100, 102), (5, 5)]
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(65)} | {100: 100, 101: 100, 102: 100}
    records = spark.createDataFrame([(1, "left"), (2, "left"), (11, "right"), (12, "right")], "record_id long, source string")
    scored = spark.createDataFrame([(1, 11, 0.9), (1, 12, 0.8), (2, 11, 0.1)], "left_id long, right_id long, score double")
    accepted = scored.where("score >= 0.5")
    found = entities.resolve(records, accepted)
    assert {(r["record_id"], r["entity"]) for r in found.collect()} == {(1, 1), (11, 1), (12, 1), (2, 2)}
    truth = entities.resolve(records, spark.createDataFrame([(1, 11)], "left_id long, right_id long"))
    row = entities.closure_merges(found, accepted, truth).first()
    assert (row["merges"], row["correct"]) == (1, 0)
    assert {r["entity"]: r["exact"] for r in entities.exact_entities(found, truth).collect()} == {1: False, 2: True}
    assert [r["entity"] for r in entities.same_source_entities(found, records).collect()] == [1]
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_closures_of_many_runs(spark):
    rng = np.random.default_rng(5)
    records = [*range(20), *range(100, 120)]
    pairs = [(run, int(a), 100 + int(b)) for run in "xy" for a, b in {(int(a), int(b)) for a, b in rng.integers(0, 20, (18, 2))}]
    truth = [(i, 100 + i) for i in range(12)] + [(3, 105)]
    def closed(edges):
        root = {r: r for r in records}
        for _ in records:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root
    true = closed(truth)
    known = entities.with_sizes(spark.createDataFrame(list(true.items()), "record_id long, entity long"))
    df = spark.createDataFrame(pairs, "run string, left_id long, right_id long")
    members = entities.resolved_runs(df, ["run"])
    counts = {r["run"]: (r["closure"], r["closure_correct"]) for r in entities.closure_counts(members, df, known, ["run"]).collect()}
    exact = {(r["run"], r["record_id"]): r["exact"] for r in entities.exact_runs(members, known, ["run"]).collect()}
    for run in "xy":
        edges = [(a, b) for k, a, b in pairs if k == run]
        root = closed(edges)
        groups = {e: {r for r in records if root[r] == e} for e in root.values()}
        added = [(a, b) for g in groups.values() if len(g) >= 3 for a, b in combinations(sorted(g), 2) if (a, b) not in edges]
        assert counts[run] == (len(added), sum(true[a] == true[b] for a, b in added))
        for a in {r for e in edges for r in e}:
            assert exact[run, a] == (groups[root[a]] == {r for r in records if true[r] == true[a]})


def plain_fit(x, y, rounds=200):
    """The same model by plain Newton steps on arrays."""
    mean, sd = x.mean(0), x.std(0)
    z = np.c_[(x - mean) / np.where(sd == 0, 1, sd), np.ones(len(x))]
    c = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, penalty = np.zeros(z.shape[1]), np.append(np.ones(x.shape[1]), 0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (c * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (c * (p - y)) + penalty * w)
    return 1 / (1 + np.exp(-z @ w))


def test_split_and_model(spark):
    rows = [(i % 40, float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(200)]
    pairs = spark.createDataFrame(rows, "right_id int, a double, b double, is_match int")
    split = model.grouped_split(pairs, seed=3)
    model.check_folds(split)
    first = sorted(range(40), key=lambda g: hashlib.md5(f"3|{g}".encode()).hexdigest())[:12]
    assert {r["right_id"] for r in split.where("fold = 'test'").select("right_id").collect()} == set(first)
    fitted = model.fit(split.where("fold = 'train'"), ("a", "b"))
    decided = POLICIES["threshold only"](split.withColumn("score", fitted.score()), 0.5)
    assert metrics.confusion(decided).first()["f1"] == 1.0
    with pytest.raises(Refused):
        model.check_features(["a", "z"], ["a"])
    with pytest.raises(Refused):
        model.fit(pairs.where("is_match = 1"), ("a",))


def test_many_models_at_once(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.1]
    y = (x @ [1.0, -0.3, 4.0] + rng.normal(size=300) > 0.4).astype(int)
    rows = [(i % 50, f"l{i}", *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, y))]
    pairs = spark.createDataFrame(rows, "right_id int, left_id string, a double, b double, c double, is_match int")
    split = model.splits(pairs, [1, 2, "x"])
    assert split.count() == 900
    scored = model.score_many(split, model.fit_many(split.where("fold = 'train'"), ("a", "b", "c")))
    for seed in ("1", "2", "x"):
        got = {r["left_id"]: r for r in scored.where(F.col("split") == seed).collect()}
        train = [i for i in range(300) if got[f"l{i}"]["fold"] == "train"]
        assert len(train) == 210
        expected = plain_fit(x[train], y[train])
        assert np.allclose([got[f"l{i}"]["score"] for i in train], expected, atol=1e-8)
    missing = pairs.withColumn("a", F.when(F.col("right_id") % 2 > 0, F.col("a"))).withColumn("b", F.lit(None).cast("double"))
    known = x.copy()
    holes = np.array([i % 50 % 2 == 0 for i in range(300)])
    known[holes, 0], known[:, 1] = known[~holes, 0].mean(), 0.0
    got = missing.withColumn("score", model.fit(missing, ("a", "b", "c")).score()).collect()
    assert np.allclose(sorted(r["score"] for r in got), sorted(plain_fit(known, y)), atol=1e-8)


def scores_of(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"l{rng.integers(0, 60)}", f"r{i % 80}", i % 5, float(np.round(rng.random(), 3)), int(rng.random() < 0.3), "test" if i % 80 < 24 else "train") for i in range(n)]
    return rows, spark.createDataFrame(rows, "left_id string, right_id string, seq int, score double, is_match int, fold string").dropDuplicates(["left_id", "right_id"])


def plain_f1(rows, threshold):
    tp = sum(r["score"] >= threshold and r["is_match"] for r in rows)
    wrong = sum((r["score"] >= threshold) != bool(r["is_match"]) for r in rows)
    return 2 * tp / (2 * tp + wrong) if tp or wrong else 0.0


def test_thresholds(spark):
    _, df = scores_of(spark)
    train = df.where("fold = 'train'").collect()
    grid = sorted({*np.linspace(0.01, 0.99, 99).round(2), 0.5, *np.quantile([r["score"] for r in train], np.linspace(0.30, 0.999, 40))})
    best = max(grid, key=lambda t: (plain_f1(train, t), -t))
    assert experiments.tune(df.where("fold = 'train'"), "threshold only") == pytest.approx(best)
    found = {(r["policy"], r["source"]): r for r in experiments.threshold_sources(df).collect()}
    assert len(found) == 9 and all(found[p, "test-oracle"]["f1"] >= found[p, s]["f1"] - 1e-12 for p in POLICIES for s in ("flat", "train-tuned"))
    monkey = metrics.candidate_thresholds
    try:
        metrics.candidate_thresholds = lambda rows: spark.createDataFrame([(2.0,)], "threshold double")  # a search that finds nothing
        with pytest.raises(Refused):
            experiments.threshold_sources(df)
    finally:
        metrics.candidate_thresholds = monkey


def test_layers(spark):
    rng = np.random.default_rng(9)
    rows = []
    for split in range(6):
        for i in range(40):
            y = int(rng.random() < 0.4)
            for name, noise in (("all", 0.1), ("few", 0.4)):
                for layer in ("pairs", "one-to-one"):
                    rows.append((layer, name, str(split), f"l{i}", f"r{i}", y, bool((rng.random() < noise) != bool(y))))
    got = {(r["layer"], r["features"]): r for r in experiments.layers_summary(spark.createDataFrame(rows, "layer string, features string, split string, left_id string, right_id string, is_match int, keep boolean")).collect()}
    def f1(layer, name, split):
        of = [(k, y) for a, b, s, _, _, y, k in rows if (a, b, s) == (layer, name, str(split))]
        tp, wrong = sum(k and y for k, y in of), sum(bool(k) != bool(y) for k, y in of)
        return 2 * tp / (2 * tp + wrong)
    for layer in ("pairs", "one-to-one"):
        a, b = [f1(layer, "all", s) for s in range(6)], [f1(layer, "few", s) for s in range(6)]
        r = got[layer, "few"]
        assert r["mean"] == pytest.approx(np.mean(b)) and r["sd"] == pytest.approx(np.std(b, ddof=1)) and r["worst"] == pytest.approx(min(b))
        assert (r["wins"], r["losses"]) == (sum(y > x + 1e-12 for x, y in zip(a, b)), sum(y < x - 1e-12 for x, y in zip(a, b)))
        assert r["p"] == pytest.approx(metrics.sign_test(r["wins"], r["losses"])) and got[layer, "all"]["wins"] is None
    keep = {(b, s, l): (k, y) for a, b, s, l, _, y, k in rows if a == "pairs"}
    changed = [(keep["few", s, l][0] == bool(y)) for (b, s, l), (k, y) in keep.items() if b == "all" and keep["few", s, l][0] != k]
    assert (got["pairs", "few"]["fixed"], got["pairs", "few"]["broken"]) == (sum(changed), len(changed) - sum(changed))
    assert got["one-to-one", "few"]["fixed"] is None


def test_statistics(spark):
    assert metrics.sign_test(0, 0) == 1.0 and metrics.sign_test(7, 7) == 1.0 and metrics.sign_test(8, 0) == pytest.approx(2 / 256)
    for n in range(1, 9):  # against all outcomes of n fair games
        for wins in range(n + 1):
            gap = abs(2 * wins - n)
            assert metrics.sign_test(wins, n - wins) == pytest.approx(sum(comb(n, k) for k in range(n + 1) if abs(2 * k - n) >= gap) / 2**n)
    assert metrics.lower_bound(40, 40) == pytest.approx(0.05 ** (1 / 40)) and metrics.lower_bound(0, 5) == 0.0 == metrics.lower_bound(0, 0)
    low = metrics.lower_bound(17, 20)
    assert sum(comb(20, i) * low**i * (1 - low) ** (20 - i) for i in range(17, 21)) == pytest.approx(0.05)
    rows, df = scores_of(spark, 100, 4)
    rate = {r["flag"]: (r["pairs"], r["true_rate"]) for r in metrics.true_rate(df, "fold").collect()}
    assert sum(n for n, _ in rate.values()) == df.count() and all(0 <= t <= 1 for _, t in rate.values())
