"""Models of several feature groups and splits in the same passes, against those fitted one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.operators import experiments, metrics, model
from braidwork.operators.blocking import Refused
from braidwork.operators.policy import POLICIES

GROUPS = {"all": ("a", "b", "c", "d"), "few": ("b",), "none": ("c", "e")}


def pairs_of(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(240, 3)) * [1, 5, 0.1]
    y = (x @ [1.0, -0.3, 4.0] + rng.normal(size=240) > 0.4).astype(int)
    rows = [(f"r{i % 60:02d}", f"l{(7 * i) % 50:02d}", i // 60, float(r[0]) if i % 5 else None, float(r[1]), float(r[2]), 0.1, None, int(k)) for i, (r, k) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "right_id string, left_id string, seq int, a double, b double, c double, d double, e double, is_match int")


def test_all_fits_at_once(spark):
    pairs = pairs_of(spark)
    cuts = model.split_cuts(pairs, [1, "x"])
    found = model.fit_tested(pairs, {name: (f, None) for name, f in GROUPS.items()}, cuts)
    train = model.splits(pairs, [1, "x"]).where("fold = 'train'")
    for name, features in GROUPS.items():
        for split, one in model.fit_many(train, features).items():
            for part in ("means", "scales", "weights", "fills", "intercept"):
                assert np.allclose(getattr(found[name][split], part), getattr(one, part), atol=1e-8)
    with pytest.raises(Refused):
        model.fit_tested(pairs.where("is_match = 1"), {"one": (("b",), None)}, cuts)


def test_layers_side_by_side(spark):
    pairs, parts = pairs_of(spark), []
    for name, features in GROUPS.items():
        rows, _ = experiments.scored_splits(pairs, [1, 2, 3], features, None)
        test = rows.where("fold = 'test'").select("split", "left_id", "right_id", "seq", "is_match", "score")
        for layer, policy in (("pairs", "threshold only"), ("one-to-one", "mutual best")):
            decided = POLICIES[policy](test, 0.5, scope=("split",))
            parts.append(decided.withColumns({"layer": F.lit(layer), "features": F.lit(name)}).drop("seq", "score"))
    shown = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert metrics.confusion(parts[1]).first()["accepted"] > 0
    one_by_one = experiments.layers_summary(experiments._runs(parts))
    assert str(shown(experiments.feature_layers(pairs, [1, 2, 3], GROUPS))) == str(shown(one_by_one))
