"""Runs over many splits, feature groups, keys and policies; pair features are worked out once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features as X
from . import blocking, entities, metrics, model
from .blocking import Refused
from .lineage import stored
from .policy import POLICIES

#: Feature groups of the ablation, for records with all fields.
GROUPS: dict[str, tuple[str, ...]] = {
    "all": X.TRAINED,
    "no category": tuple(f for f in X.TRAINED if f != "same_category"),
    "no price": tuple(f for f in X.TRAINED if f != "price_relative_diff"),
    "no category, no price": X.TRAINED[:4],
    "title only": ("sequence_ratio", "word_jaccard", "length_ratio"),
    "cosine only": ("cosine",),
    "price only": ("price_relative_diff",),
    "volume only": ("volume_conflict", "volume_match", "volume_one_sided"),
}
#: The same for records whose fields may be missing.
GROUPS_MISSING: dict[str, tuple[str, ...]] = {
    "all": X.TRAINED_MISSING,
    "no description": tuple(f for f in X.TRAINED_MISSING if f != "description_jaccard"),
    "no price": tuple(f for f in X.TRAINED_MISSING if not f.startswith("price")),
    "no manufacturer": tuple(f for f in X.TRAINED_MISSING if not f.startswith("manufacturer")),
    "name only": ("cosine", "sequence_ratio", "length_ratio", "word_jaccard"),
    "cosine only": ("cosine",),
    "price only": ("price_relative_diff", "price_known"),
    "description only": ("description_jaccard",),
}


def check_groups(groups: dict[str, Sequence[str]], known: Sequence[str], reference: str = "all") -> None:
    if reference not in groups:
        raise Refused(f"no reference group {reference!r}")
    for features in groups.values():
        model.check_features(features, known)


def pair_table(left: DataFrame, right: DataFrame, truth: DataFrame, k: int, features: Callable[..., dict[str, Column]] = X.plain) -> DataFrame:
    """Candidates with the features of their records and ``is_match``."""
    ids = ["left_id", "right_id"]
    side = lambda df, s: df.select(f"{s}_id", *[F.col(c).alias(f"{s}_{c}") for c in df.columns if c != f"{s}_id"])
    rows = blocking.nearest_neighbours(left, right, k).join(side(left, "left"), "left_id").join(side(right, "right"), "right_id")
    known = truth.select(*ids).distinct().withColumn("_true", F.lit(1))
    rows = rows.join(known, ids, "left").withColumn("is_match", F.coalesce("_true", F.lit(0)))
    made = features()
    return rows.select(*ids, "seq", "cosine", *[c.alias(n) for n, c in made.items()], "is_match")


def scored_splits(
    pairs: DataFrame, seeds: Sequence, features: Sequence[str] = X.TRAINED, constraint: str | None = "volume_conflict"
) -> tuple[DataFrame, dict[str, model.Scorer]]:
    """``pairs`` once per seed with split, fold and ``score``, by a model fitted on the split's training fold."""
    cuts = model.split_cuts(pairs, seeds)
    fitted = model.fit_tested(pairs, {"one": (features, constraint)}, cuts)["one"]
    return model.score_many(model.splits(pairs, seeds, cuts=cuts), fitted), fitted


def scored(pairs: DataFrame, seed, features: Sequence[str] = X.TRAINED, constraint: str | None = "volume_conflict") -> tuple[DataFrame, model.Scorer]:
    """``scored_splits`` of one seed."""
    rows, fitted = scored_splits(pairs, [seed], features, constraint)
    return rows.drop("split"), fitted[str(seed)]


def _runs(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ablation(pairs: DataFrame, groups: dict[str, Sequence[str]] = GROUPS, seed=0, threshold: float = 0.5) -> DataFrame:
    """Precision, recall and F1 on the test fold for each feature group, and the distance to ``all``."""
    check_groups(groups, pairs.columns)
    cuts = model.split_cuts(pairs, [seed])
    fitted = model.fit_tested(pairs, {name: (features, None) for name, features in groups.items()}, cuts)
    test, parts = stored(model.splits(pairs, [seed], cuts=cuts).where("fold = 'test'"), "test"), []
    for name in groups:
        decided = POLICIES["threshold only"](model.score_many(test, fitted[name]), threshold)
        parts.append(metrics.confusion(decided).withColumn("features", F.lit(name)))
    runs = _runs(parts)
    reference = runs.where("features = 'all'").select(F.col("f1").alias("_all"))
    return runs.join(F.broadcast(reference)).withColumn("delta", F.col("f1") - F.col("_all")).drop("_all")


def decide_splits(rows: DataFrame, threshold: float, policies: Sequence[str], scope: str = "table") -> DataFrame:
    """``rows`` (with split and fold) once per policy, with ``policy`` and ``keep``.

    ``scope`` is what competes for a record: pairs of the whole ``table``, or of the test ``fold`` alone.
    """
    if scope not in ("table", "fold"):
        raise Refused(f"scope is table or fold, not {scope!r}")
    within = ("split", "fold") if scope == "fold" else ("split",)
    return _runs([POLICIES[name](rows, threshold, scope=within).withColumn("policy", F.lit(name)) for name in policies])


def sweep(rows: DataFrame, records: DataFrame, truth: DataFrame, threshold: float = 0.5, policies: Sequence[str] = tuple(POLICIES), scope: str = "table") -> DataFrame:
    """A row per split and policy: test-fold metrics, accepted pairs, and what closing them does.

    ``rows`` are scored pairs of all splits; ``records`` has every record_id; ``truth`` has left_id and
    right_id. ``exact`` is the share of the test fold's right records whose entity is their true one;
    ``closure`` counts pairs that only closing joins, ``closure_correct`` those that are right. All splits
    and policies are closed in one run of components.
    """
    by = ["split", "policy"]
    decided = stored(decide_splits(rows, threshold, policies, scope).select(*by, "fold", "left_id", "right_id", "is_match", "keep"), "decided")
    # What is accepted is counted on the whole table, the rest on the test fold.
    accepted = decided.groupBy(*by).agg(F.count_if("keep").alias("accepted"))
    runs = metrics.confusion(decided.where("fold = 'test'"), by=tuple(by)).drop("accepted")
    true = stored(entities.with_sizes(entities.resolve(records, truth)), "truth")
    members = stored(entities.resolved_runs(decided.where("keep"), by), "members")
    merges = entities.closure_counts(members, decided.where("keep"), true, by)
    whole = entities.exact_runs(members, true, by)
    held = decided.where("fold = 'test'").select(*by, F.col("right_id").alias("record_id")).distinct()
    held = held.join(whole.select(*by, "record_id", "exact"), [*by, "record_id"], "left").join(true, "record_id")
    alone = F.col("truth_size") == 1
    share = held.groupBy(*by).agg(F.avg(F.coalesce("exact", alone).cast("double")).alias("exact"))
    out = runs.join(accepted, by).join(share, by).join(merges, by, "left")
    return out.fillna(0, ["closure", "closure_correct"])


def sweep_scored(pairs: DataFrame, seeds: Sequence, records: DataFrame, truth: DataFrame, threshold: float = 0.5, policies: Sequence[str] = tuple(POLICIES)) -> DataFrame:
    """``sweep`` over splits of pairs whose score is the same in all of them, with the whole table as the scope.

    Decisions and entities are then those of every split, so they are made once for each policy; each right record's
    counts go to the splits that test it.
    """
    by = ["policy"]
    rows = pairs.withColumn("split", F.lit("all"))
    decided = decide_splits(rows, threshold, policies).select(*by, "left_id", "right_id", "is_match", "keep")
    decided = stored(decided, "decided")
    accepted = decided.groupBy(*by).agg(F.count_if("keep").alias("accepted"))
    true = stored(entities.with_sizes(entities.resolve(records, truth)), "truth")
    members = stored(entities.resolved_runs(decided.where("keep"), by), "members")
    merges = entities.closure_counts(members, decided.where("keep"), true, by)
    k, t = F.col("keep"), F.col("is_match") == 1
    counts = ("true_positive", "false_positive", "false_negative")
    rights = decided.groupBy(*by, "right_id").agg(*[F.count_if(c).alias(n) for n, c in zip(counts, (k & t, k & ~t, ~k & t))])
    whole = entities.exact_runs(members, true, by).select(*by, F.col("record_id").alias("right_id"), "exact")
    alone = true.select(F.col("record_id").alias("right_id"), (F.col("truth_size") == 1).alias("alone"))
    rights = rights.join(whole, [*by, "right_id"], "left").join(alone, "right_id", "left")
    rights = stored(rights.withColumn("exact", F.coalesce("exact", "alone").cast("double")).drop("alone"), "rights")
    tested = model.splits(rights, seeds).where("fold = 'test'")
    sums = tested.groupBy("split", *by).agg(*[F.sum(c).alias(c) for c in counts], F.avg("exact").alias("exact"))
    out = sums.select("split", *by, *metrics.rates(), *counts, "exact").join(accepted, by).join(merges, by, "left")
    out = out.select("split", *by, "precision", "recall", "f1", *counts, "accepted", "exact", "closure", "closure_correct")
    return out.fillna(0, ["closure", "closure_correct"])


def tune(rows: DataFrame, policy: str) -> float:
    """The threshold with the best F1 of a policy on the pairs given; the smallest of equals.

    Which pairs a policy can keep doesn't depend on the threshold, so it decides once for all of them.
    """
    able = POLICIES[policy](rows, float("-inf")).withColumnRenamed("keep", "eligible")
    grid = metrics.threshold_grid(able, metrics.candidate_thresholds(rows), eligible="eligible")
    return metrics.best_threshold(grid).first()["threshold"]


def threshold_sources(rows: DataFrame, flat: float = 0.5, policies: Sequence[str] = tuple(POLICIES)) -> DataFrame:
    """Each policy on the test fold at a flat threshold, the one tuned on the training fold, and the test fold's best.

    Refuses if the best is below the flat one: then the search missed it and it bounds nothing.
    """
    train, test = rows.where("fold = 'train'"), rows.where("fold = 'test'")
    parts = []
    for name in policies:
        sources = {"flat": flat, "train-tuned": tune(train, name), "test-oracle": tune(test, name)}
        for source, threshold in sources.items():
            run = metrics.confusion(POLICIES[name](test, threshold))
            parts.append(run.withColumns({"policy": F.lit(name), "source": F.lit(source), "threshold": F.lit(float(threshold))}))
    runs = stored(_runs(parts), "sources")
    f1 = {(r["policy"], r["source"]): r["f1"] for r in runs.select("policy", "source", "f1").collect()}  # a few rows
    for name in policies:
        if f1[name, "test-oracle"] < f1[name, "flat"] - 1e-12:
            raise Refused(f"the best threshold of {name!r} is below the flat one: the search missed it")
    return runs


def feature_layers(pairs: DataFrame, seeds: Sequence, groups: dict[str, Sequence[str]] = GROUPS_MISSING, threshold: float = 0.5) -> DataFrame:
    """A row per layer (single pairs, one-to-one) and feature group over all splits, compared with ``all``.

    Mean, standard deviation, worst and best F1, wins, losses and their exact sign test against ``all`` on
    the same splits; for single pairs, how many test decisions changed and agree (fixed) or not (broken).
    """
    check_groups(groups, pairs.columns)
    cuts = model.split_cuts(pairs, seeds)
    fitted = model.fit_tested(pairs, {name: (features, None) for name, features in groups.items()}, cuts)
    rows, names = model.splits(pairs, seeds, cuts=cuts).where("fold = 'test'"), list(groups)
    for i, name in enumerate(names):
        rows = model.score_many(rows, fitted[name]).withColumnRenamed("score", f"_s{i}")
    rows = rows.select("split", "left_id", "right_id", "seq", "is_match", *[f"_s{i}" for i in range(len(names))])
    # All groups' pairs compete side by side: one sort for each side, and nothing is joined.
    first = lambda i, *ties: F.struct((-F.col(f"_s{i}")).alias("s"), *ties)
    for side, ties in (("right", ("seq", "left_id")), ("left", ("right_id",))):
        among = Window.partitionBy("split", f"{side}_id")
        rows = rows.select("*", *[(first(i, *ties) == F.min(first(i, *ties)).over(among)).alias(f"_{side}{i}") for i in range(len(names))])
    able = lambda i: F.coalesce(F.col(f"_s{i}") >= threshold, F.lit(False))
    t, of_all = F.col("is_match") == 1, names.index("all")
    counts, shown = [], []
    for layer, keep in (("pairs", able), ("one-to-one", lambda i: F.col(f"_right{i}") & F.col(f"_left{i}") & able(i))):
        for i, name in enumerate(names):
            k, other = keep(i), keep(of_all)
            wanted = {"true_positive": k & t, "false_positive": k & ~t, "false_negative": ~k & t, "fixed": (k != other) & (k == t), "broken": (k != other) & (k != t)}
            made = {c: f"{layer} {i} {c}" for c in wanted}
            counts += [F.count_if(x).alias(made[c]) for c, x in wanted.items()]
            shown.append(F.struct(F.lit(layer).alias("layer"), F.lit(name).alias("features"), *[F.col(at).alias(c) for c, at in made.items()]))
    runs = stored(rows.groupBy("split").agg(*counts).select("split", F.inline(F.array(*shown))).select("*", *metrics.rates()), "runs")
    changes = runs.where("layer = 'pairs'").groupBy("layer", "features").agg(F.sum("fixed").alias("fixed"), F.sum("broken").alias("broken"))
    return _layers(runs, changes)


def layers_summary(decided: DataFrame, reference: str = "all") -> DataFrame:
    """The summary of ``feature_layers`` from decisions with layer, features, split, left_id, right_id, is_match and keep."""
    by = ["layer", "features"]
    runs = stored(metrics.confusion(decided, by=(*by, "split")), "runs")
    ids = ["layer", "split", "left_id", "right_id"]
    mine = decided.where("layer = 'pairs'")
    kept = mine.where(F.col("features") == reference).select(*ids, F.col("keep").alias("_keep"))
    changed = mine.join(kept, ids).where(F.col("keep") != F.col("_keep"))
    right = F.col("keep") == (F.col("is_match") == 1)
    return _layers(runs, changed.groupBy(*by).agg(F.count_if(right).alias("fixed"), F.count_if(~right).alias("broken")), reference)


def _layers(runs: DataFrame, changes: DataFrame, reference: str = "all") -> DataFrame:
    by = ["layer", "features"]
    base = metrics.summary(runs, tuple(by), "f1")
    other = runs.where(F.col("features") == reference).select("layer", "split", F.col("f1").alias("_f1"))
    gap = F.col("f1") - F.col("_f1")
    paired = runs.join(other, ["layer", "split"]).groupBy(*by).agg(
        F.count_if(gap > 1e-12).alias("wins"), F.count_if(gap < -1e-12).alias("losses")
    )
    out = base.join(paired, by).join(changes, by, "left")
    # The test's value follows from two small numbers, so it is looked up per pair of numbers.
    met = [(r["wins"], r["losses"]) for r in paired.select("wins", "losses").distinct().collect()]
    p = runs.sparkSession.createDataFrame([(a, b, metrics.sign_test(a, b)) for a, b in met], "wins bigint, losses bigint, p double")
    same = F.col("features") == reference
    out = out.join(F.broadcast(p), ["wins", "losses"]).withColumns(
        {c: F.when(~same, F.col(c)) for c in ("wins", "losses", "p")}
    )
    none = lambda c: F.when(F.col("layer") == "pairs", F.coalesce(c, F.lit(0)))
    return out.select(*by, "mean", "sd", "worst", "best", "wins", "losses", "p", none("fixed").alias("fixed"), none("broken").alias("broken"))


def volume_experiment(pairs: DataFrame, seed=0, threshold: float = 0.5) -> DataFrame:
    """Volume numbers left out, learned, as a veto, and both; per pair and one per right record."""
    learned = (*X.TRAINED, "volume_conflict", "volume_match", "volume_one_sided")
    kinds = {
        "without": (X.TRAINED, None), "learned": (learned, None),
        "veto": (X.TRAINED, "volume_conflict"), "learned and veto": (learned, "volume_conflict"),
    }
    cuts = model.split_cuts(pairs, [seed])
    fitted = model.fit_tested(pairs, kinds, cuts)
    test, parts = stored(model.splits(pairs, [seed], cuts=cuts).where("fold = 'test'"), "test"), []
    for name in kinds:
        rows = model.score_many(test, fitted[name])
        for policy in ("threshold only", "best per right"):
            decided = POLICIES[policy](rows, threshold)
            parts.append(metrics.confusion(decided).withColumn("volumes", F.lit(name)).withColumn("policy", F.lit(policy)))
    return _runs(parts)


def key_budgets(left: DataFrame, right: DataFrame, truth: DataFrame, name: str, a: Callable, b: Callable, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """Pairs and recall of two keys' candidates and of their union for several k: what an equal number of pairs buys."""
    t = truth.select("left_id", "right_id").distinct()
    total = t.agg(F.count("*").alias("truths"))
    top = {}
    for label, f in (("first key", a), ("second key", b)):
        found = blocking.nearest_neighbours(blocking.rekey(left, name, f), blocking.rekey(right, name, f), max(ks))
        top[label] = stored(found.select("left_id", "right_id", "seq"), "candidates")
    parts = []
    for k in ks:
        sets = {label: found.where(F.col("seq") <= k).select("left_id", "right_id") for label, found in top.items()}
        sets["union"] = blocking.union_pairs(*sets.values())
        for label, pairs in sets.items():
            hit = pairs.join(t.withColumn("_true", F.lit(1)), ["left_id", "right_id"], "left")
            run = hit.agg(F.count("*").alias("pairs"), F.count("_true").alias("found"))
            parts.append(run.withColumns({"strategy": F.lit(label), "k": F.lit(k)}))
    runs = _runs(parts).join(F.broadcast(total))
    return runs.select("strategy", "k", "pairs", "found", F.try_divide("found", "truths").alias("recall"))


def key_variants(left: DataFrame, right: DataFrame, truth: DataFrame, name: str, a: Callable, b: Callable, k: int) -> DataFrame:
    """True pairs that one key's candidates reach and the other's don't: ``gained`` by b, ``lost`` by b."""
    t = truth.select("left_id", "right_id").distinct()

    def reached(f: Callable) -> DataFrame:
        found = blocking.nearest_neighbours(blocking.rekey(left, name, f), blocking.rekey(right, name, f), k)
        return t.join(found.select("left_id", "right_id"), ["left_id", "right_id"], "left_semi")

    x, y = reached(a), reached(b)
    gained = y.exceptAll(x).withColumn("change", F.lit("gained"))
    return gained.unionByName(x.exceptAll(y).withColumn("change", F.lit("lost")))


def end_to_end(decided: DataFrame, truth: DataFrame, groups: DataFrame) -> DataFrame:
    """Kept true pairs over all labels of the groups (right records) in question, those never generated included."""
    t = truth.select("left_id", "right_id").distinct().join(groups.select("right_id").distinct(), "right_id", "left_semi")
    found = t.join(decided.where("keep"), ["left_id", "right_id"], "left_semi").agg(F.count("*").alias("found"))
    return t.agg(F.count("*").alias("truths")).join(F.broadcast(found)).withColumn("recall", F.try_divide("found", "truths"))
