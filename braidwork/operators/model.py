"""Grouped splits, a class-balanced logistic model and its score as an expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocking import Refused
from .lineage import stored
from .policy import veto


def uniform(seed, *parts: Column) -> Column:
    """0 to 1 from an MD5 of a seed and values: the same in any engine and on any split of the work."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def cut_hashes(hashed: DataFrame, ranks: dict, by: str = "split", hash_: str = "_u") -> dict:
    """For each value of ``by`` the hash (hexadecimal text, distinct within it) of the rank asked for, from 1.

    Counts per beginning of the hash lead to the one that holds the rank, at most 65,536 of them at a time
    for each value; only hashes of that beginning come to the driver. No task ranks all rows.
    """
    found = {v: "" for v, rank in ranks.items() if rank <= 0}
    open_ = {v: ("", rank) for v, rank in ranks.items() if rank > 0}
    spark = hashed.sparkSession
    while open_:
        starts = spark.createDataFrame([(v, p) for v, (p, _) in open_.items()], f"_by {dict(hashed.dtypes)[by]}, _start string")
        rows = hashed.join(F.broadcast(starts), (F.col(by) == F.col("_by")) & F.col(hash_).startswith(F.col("_start")))
        longer = F.substring(hash_, F.lit(1), F.length("_start") + 4).alias("_next")
        counts: dict = {}
        for r in rows.groupBy(by, longer).agg(F.count("*").alias("n")).collect():
            counts.setdefault(r[by], []).append((r["_next"], r["n"]))
        ends = {}
        for v, (_, rank) in open_.items():
            for start, n in sorted(counts[v]):
                if rank <= n:
                    ends[v] = (start, rank, n)
                    break
                rank -= n
        open_ = {v: (start, rank) for v, (start, rank, n) in ends.items() if n > 10_000}
        last = {v: (start, rank) for v, (start, rank, n) in ends.items() if n <= 10_000}
        if last:
            starts = spark.createDataFrame([(v, p) for v, (p, _) in last.items()], f"_by {dict(hashed.dtypes)[by]}, _start string")
            rows = hashed.join(F.broadcast(starts), (F.col(by) == F.col("_by")) & F.col(hash_).startswith(F.col("_start")))
            kept: dict = {}
            for r in rows.select(by, hash_).collect():
                kept.setdefault(r[by], []).append(r[hash_])
            found |= {v: sorted(kept[v])[rank - 1] for v, (_, rank) in last.items()}
    return found


def _share(n: int, share: float) -> int:
    return -(-int(round(n * share * 1e9)) // 10**9)


def _hashed(seed, group: str) -> Column:
    return F.md5(F.concat_ws("|", seed, F.col(group).cast("string")))


def split_cuts(pairs: DataFrame, seeds: Sequence, group: str = "right_id", test_share: float = 0.3) -> dict[str, str]:
    """For each seed the hash up to which groups go to test, ceil(share * groups) of them."""
    split = F.explode(F.array(*[F.lit(str(s)) for s in seeds])).alias("split")
    groups = pairs.select(group).distinct()
    take = _share(groups.count(), test_share)
    ranked = groups.select(group, split).select("split", _hashed(F.col("split"), group).alias("_u"))
    return cut_hashes(ranked, {str(s): take for s in seeds})


def splits(pairs: DataFrame, seeds: Sequence, group: str = "right_id", test_share: float = 0.3, cuts: dict[str, str] | None = None) -> DataFrame:
    """``pairs`` once per seed, with ``split`` (the seed) and ``fold``.

    Whole groups go to test, those first by seeded hash. A group's fold follows from its own hash and the
    hash at that rank (``split_cuts``), so pairs are not joined with anything.
    """
    cuts = cuts or split_cuts(pairs, seeds, group, test_share)
    split = F.explode(F.array(*[F.lit(str(s)) for s in seeds])).alias("split")
    cut = F.element_at(F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]), F.col("split"))
    return pairs.select("*", split).withColumn("fold", F.when(_hashed(F.col("split"), group) <= cut, "test").otherwise("train"))


def grouped_split(pairs: DataFrame, group: str = "right_id", seed=0, test_share: float = 0.3) -> DataFrame:
    """Adds ``fold``: one of ``splits``."""
    return splits(pairs, [seed], group, test_share).drop("split")


def check_folds(split: DataFrame, group: str = "right_id") -> None:
    both = split.groupBy(group).agg(F.count_distinct("fold").alias("n")).where("n > 1")
    if both.head(1):
        raise Refused(f"a {group} is in both folds")


@dataclass(frozen=True)
class Scorer:
    """A fitted model; ``score`` is a plain expression, so scoring needs no Python."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    fills: tuple[float, ...]
    constraint: str | None = None

    def raw(self) -> Column:
        total = F.lit(self.intercept)
        for name, mean, scale, weight, fill in zip(self.features, self.means, self.scales, self.weights, self.fills):
            total = total + F.lit(weight) * (F.coalesce(F.col(name), F.lit(fill)) - mean) / scale
        return 1 / (1 + F.exp(-total))

    def score(self) -> Column:
        return veto(self.raw(), F.col(self.constraint)) if self.constraint else self.raw()

    def coefficients(self) -> list[tuple[str, float]]:
        return sorted(zip(self.features, self.weights), key=lambda p: -abs(p[1]))


def check_features(features: Sequence[str], known: Sequence[str]) -> None:
    if unknown := sorted(set(features) - set(known)):
        raise Refused(f"no such features: {unknown}")


def train_means(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Means of the training fold; 0 for a column without any value."""
    row = train.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return {c: 0.0 if row[c] is None else row[c] for c in columns}


def impute(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    fills = train_means(train, columns)
    return train.fillna(fills), test.fillna(fills)


def fit(train: DataFrame, features: Sequence[str], label: str = "is_match", constraint: str | None = None, rounds: int = 100) -> Scorer:
    """One of ``fit_many``."""
    one = train.withColumn("_split", F.lit("0"))
    return fit_many(one, features, label, constraint, rounds, "_split")["0"]


def fit_many(
    train: DataFrame, features: Sequence[str], label: str = "is_match", constraint: str | None = None, rounds: int = 100, by: str = "split"
) -> dict[str, Scorer]:
    """A model for each value of ``by``, all in the same passes.

    Missing values become the mean of the split's training rows; features are standardised by them. Classes
    are balanced and weights have an L2 penalty of 1, the intercept has none. Newton's method: each pass
    sums the gradient and the curvature of all splits, a few numbers per split whatever the rows.
    """
    d, spark = len(features), train.sparkSession
    numbers = [f"f{i}" for i in range(d)]
    rows = train.select(F.col(by).alias("_by"), F.col(label).cast("double").alias("y"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, numbers)])
    fills = {r["_by"]: [r[n] or 0.0 for n in numbers] for r in rows.groupBy("_by").agg(*[F.avg(n).alias(n) for n in numbers]).collect()}

    def with_arrays(df: DataFrame, **arrays: dict) -> DataFrame:
        table = [(v, *[[float(x) for x in a[v]] for a in arrays.values()]) for v in fills]
        made = spark.createDataFrame(table, f"_by {dict(rows.dtypes)['_by']}, " + ", ".join(f"_{n} array<double>" for n in arrays))
        return df.join(F.broadcast(made), "_by")

    filled = lambda i, n: F.coalesce(F.col(n), F.get("_fill", F.lit(i)))
    stats = with_arrays(rows, fill=fills).groupBy("_by").agg(
        F.count("*").alias("n"), F.sum("y").alias("pos"), *[F.avg(filled(i, n)).alias(f"m{i}") for i, n in enumerate(numbers)],
        *[F.stddev_pop(filled(i, n)).alias(f"s{i}") for i, n in enumerate(numbers)],
    ).collect()
    stats = {r["_by"]: r for r in stats}
    if not stats or any(not 0 < r["pos"] < r["n"] for r in stats.values()):
        raise Refused("training needs both classes")
    means = {v: [r[f"m{i}"] for i in range(d)] for v, r in stats.items()}
    scales = {v: [r[f"s{i}"] or 1.0 for i in range(d)] for v, r in stats.items()}
    balance = {v: [r["n"] / (2 * (r["n"] - r["pos"])), r["n"] / (2 * r["pos"])] for v, r in stats.items()}
    z = lambda i, n: (filled(i, n) - F.get("_mean", F.lit(i))) / F.get("_scale", F.lit(i))
    base = with_arrays(rows, fill=fills, mean=means, scale=scales, balance=balance).select(
        "_by", "y", F.get("_balance", F.col("y").cast("int")).alias("c"), *[z(i, n).alias(n) for i, n in enumerate(numbers)]
    )
    base = stored(base, "training") if len(fills) > 1 else base
    now = {v: np.zeros(d + 1) for v in fills}
    for _ in range(rounds):
        total = F.get("_w", F.lit(d))
        for i, n in enumerate(numbers):
            total = total + F.get("_w", F.lit(i)) * F.col(n)
        p = (1 / (1 + F.exp(-total))).alias("p")
        at = with_arrays(base, w=now).select("_by", "y", "c", *numbers, p)
        inner = [*numbers, "one"]
        at = at.withColumn("one", F.lit(1.0)).withColumn("g", F.col("c") * (F.col("p") - F.col("y"))).withColumn("h", F.col("c") * F.col("p") * (1 - F.col("p")))
        sums = [F.sum(F.col("g") * F.col(n)).alias(f"g_{n}") for n in inner]
        sums += [F.sum(F.col("h") * F.col(a) * F.col(b)).alias(f"h_{a}_{b}") for i, a in enumerate(inner) for b in inner[i:]]
        largest = 0.0
        for r in at.groupBy("_by").agg(*sums).collect():
            w = now[r["_by"]]
            penalty = np.append(np.ones(d), 0.0)
            gradient = np.array([r[f"g_{n}"] for n in inner]) + penalty * w
            curve = np.array([[r[f"h_{inner[min(i, j)]}_{inner[max(i, j)]}"] for j in range(d + 1)] for i in range(d + 1)])
            step = np.linalg.solve(curve + np.diag(penalty + 1e-12), gradient)
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))  # far from the optimum the curve says little
            now[r["_by"]] = w - step
            largest = max(largest, float(np.abs(step).max()))
        if largest < 1e-10:
            break
    return {
        v: Scorer(tuple(features), tuple(means[v]), tuple(scales[v]), tuple(map(float, w[:d])), float(w[d]), tuple(fills[v]), constraint)
        for v, w in now.items()
    }


def fit_tested(
    pairs: DataFrame, wanted: dict[str, tuple[Sequence[str], str | None]], cuts: dict[str, str], group: str = "right_id",
    label: str = "is_match", rounds: int = 100,
) -> dict[str, dict[str, Scorer]]:
    """For each name the models of ``fit_many`` over its features, one for each split of ``cuts``.

    All models are fitted in the same passes over one table of the pairs, which are not repeated for splits or
    features: a task adds up the sums of all models over its rows and hands over those alone.
    """
    for features, _ in wanted.values():
        check_features(features, pairs.columns)
    columns = sorted({f for features, _ in wanted.values() for f in features})
    seeds, d = list(cuts), len(columns)
    train = F.array(*[_hashed(F.lit(s), group) > F.lit(cuts[s]) for s in seeds]).alias("train")
    rows = stored(pairs.select(train, F.col(label).cast("double").alias("y"), *[F.col(c).cast("double") for c in columns]), "training")

    def folds(batches):
        """(number of the split, features, labels) of the training rows of each batch and split."""
        for b in batches:
            if b.num_rows:
                mine = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(b.num_rows, len(seeds))
                y = b.column(1).to_numpy(zero_copy_only=False)
                x = np.column_stack([b.column(i + 2).to_numpy(zero_copy_only=False).astype(float) for i in range(d)])
                for s in range(len(seeds)):
                    yield s, x[mine[:, s]], y[mine[:, s]]

    def summed(of, size: int, combine=np.add) -> np.ndarray:
        """What ``of`` (features, labels, split) makes of all training rows of each split, combined over batches and tasks."""
        import pyarrow as pa

        start = 0.0 if combine is np.add else np.nan

        def run(batches):
            total = np.full((len(seeds), size), start)
            for s, x, y in folds(batches):
                if len(y):
                    total[s] = combine(total[s], of(x, y, s))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        parts = [np.frombuffer(bytes(r["sums"])).reshape(len(seeds), size) for r in rows.mapInArrow(run, "sums binary").collect()]
        return combine.reduce(parts) if parts else np.full((len(seeds), size), start)

    first = summed(lambda x, y, s: np.concatenate([[len(y), y.sum()], (~np.isnan(x)).sum(0), np.nansum(x, 0)]), 2 + 2 * d)
    n, pos, known, sums = first[:, 0], first[:, 1], first[:, 2 : 2 + d], first[:, 2 + d :]
    if not len(seeds) or ((pos <= 0) | (pos >= n)).any():
        raise Refused("training needs both classes")
    ends = summed(lambda x, y, s: np.concatenate([np.fmin.reduce(x, 0), np.fmin.reduce(-x, 0)]), 2 * d, np.fmin)
    same = ends[:, :d] == -ends[:, d:]
    # What is missing becomes the mean, which the mean itself doesn't notice.
    means = np.where(known > 0, np.where(same, ends[:, :d], sums / np.maximum(known, 1)), 0.0)
    squares = summed(lambda x, y, s: np.nansum((x - means[s]) ** 2, 0), d)
    scales = np.sqrt(squares / n[:, None])
    scales[same | (scales == 0)] = 1.0
    balance = np.stack([n / (2 * (n - pos)), n / (2 * pos)], 1)
    at = {name: [columns.index(f) for f in features] for name, (features, _) in wanted.items()}
    now = {(name, s): np.zeros(len(of) + 1) for name, of in at.items() for s in range(len(seeds))}
    active = set(now)
    sizes = {name: (len(of) + 1) * (len(of) + 2) for name, of in at.items()}
    starts = dict(zip(at, np.append(0, np.cumsum(list(sizes.values())))))

    def slopes(x, y, s):
        z = np.where(np.isnan(x), 0.0, (x - means[s]) / scales[s])
        c, out = balance[s][y.astype(int)], np.zeros(sum(sizes.values()))
        for name, of in at.items():
            if (name, s) in active:
                w, one = now[name, s], np.column_stack([z[:, of], np.ones(len(y))])
                p = 1 / (1 + np.exp(-(one @ w)))
                found = np.concatenate([one.T @ (c * (p - y)), ((one * (c * p * (1 - p))[:, None]).T @ one).ravel()])
                out[starts[name] : starts[name] + sizes[name]] = found
        return out

    for _ in range(rounds):
        total = summed(slopes, sum(sizes.values()))
        for name, s in sorted(active):
            w, m = now[name, s], len(at[name]) + 1
            mine = total[s, starts[name] : starts[name] + sizes[name]]
            penalty = np.append(np.ones(m - 1), 0.0)
            step = np.linalg.solve(mine[m:].reshape(m, m) + np.diag(penalty + 1e-12), mine[:m] + penalty * w)
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))  # far from the optimum the curve says little
            now[name, s] = w - step
            if np.abs(step).max() < 1e-10:
                active.discard((name, s))
        if not active:
            break
    numbers = lambda a, of: tuple(float(a[i]) for i in of)
    return {
        name: {
            seed: Scorer(tuple(features), numbers(means[s], at[name]), numbers(scales[s], at[name]), tuple(map(float, now[name, s][:-1])),
                         float(now[name, s][-1]), numbers(means[s], at[name]), constraint)
            for s, seed in enumerate(seeds)
        }
        for name, (features, constraint) in wanted.items()
    }


def score_many(rows: DataFrame, scorers: dict[str, Scorer], by: str = "split") -> DataFrame:
    """Adds ``score`` by the model of each row's split: a small table of numbers and one expression."""
    one = next(iter(scorers.values()))
    kind = dict(rows.dtypes)[by]
    table = [(v, list(s.means), list(s.scales), list(s.weights), s.intercept, list(s.fills)) for v, s in scorers.items()]
    made = rows.sparkSession.createDataFrame(table, f"_by {kind}, _m array<double>, _s array<double>, _w array<double>, _b double, _f array<double>")
    total = F.col("_b")
    for i, name in enumerate(one.features):
        at = lambda c: F.get(c, F.lit(i))  # noqa: B023, E731
        total = total + at("_w") * (F.coalesce(F.col(name), at("_f")) - at("_m")) / at("_s")
    score = 1 / (1 + F.exp(-total))
    score = veto(score, F.col(one.constraint)) if one.constraint else score
    out = rows.join(F.broadcast(made), F.col(by) == F.col("_by")).withColumn("score", score)
    return out.drop("_by", "_m", "_s", "_w", "_b", "_f")
