"""Scores of decisions, summaries over splits and exact tests."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(decided: DataFrame, by: tuple[str, ...] = (), keep: str = "keep", truth: str = "is_match") -> DataFrame:
    """Precision, recall (null without positives), F1 and counts of decisions, in one pass."""
    k, t = F.col(keep), F.col(truth) == 1
    counts = decided.groupBy(*by).agg(
        F.count_if(k & t).alias("true_positive"),
        F.count_if(k & ~t).alias("false_positive"),
        F.count_if(~k & t).alias("false_negative"),
        F.count_if(k).alias("accepted"),
    )
    return counts.select(*by, *rates(), "true_positive", "false_positive", "false_negative", "accepted")


def rates() -> list[Column]:
    tp, fp, fn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative"))
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision")
    recall = F.try_divide(tp, tp + fn).alias("recall")
    return [precision, recall, F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1")]


def threshold_grid(scored: DataFrame, thresholds: DataFrame, score: str = "score", eligible: str | None = None) -> DataFrame:
    """The confusion at each of a bounded table of thresholds (column ``threshold``).

    What decides between pairs doesn't depend on the threshold, so ``eligible`` is worked out once; pairs
    are counted between neighbouring thresholds and the counts summed from above.
    """
    from pyspark.sql import Window

    ok = F.col(eligible) if eligible else F.lit(True)
    cuts = [r["threshold"] for r in thresholds.select("threshold").distinct().orderBy("threshold").collect()]
    grid = F.array(*[F.lit(float(c)) for c in cuts])
    step = F.when(ok, F.size(F.filter(grid, lambda c: c <= F.col(score)))).otherwise(0)
    counts = scored.select(step.alias("step"), F.col("is_match")).groupBy("step").agg(
        F.count_if(F.col("is_match") == 1).alias("pos"), F.count_if(F.col("is_match") == 0).alias("neg")
    )
    spark = scored.sparkSession
    steps = spark.createDataFrame([(i + 1, c) for i, c in enumerate(cuts)] + [(0, None)], "step int, threshold double")
    rows = F.broadcast(steps).join(counts, "step", "left").fillna(0, ["pos", "neg"])
    down = Window.orderBy(F.col("step").desc())
    rows = rows.withColumn("true_positive", F.sum("pos").over(down)).withColumn("false_positive", F.sum("neg").over(down))
    whole = Window.partitionBy(F.lit(1))
    rows = rows.withColumn("false_negative", F.sum("pos").over(whole) - F.col("true_positive")).where("step > 0")
    return rows.select("threshold", *rates(), "true_positive", "false_positive", "false_negative")


def best_threshold(grid: DataFrame) -> DataFrame:
    """The first threshold with the highest F1."""
    return grid.orderBy(F.col("f1").desc(), "threshold").limit(1)


def baseline_thresholds(scored: DataFrame, score: str = "cosine") -> DataFrame:
    """80 quantiles from 0.50 to 0.999."""
    at = [0.50 + (0.999 - 0.50) * i / 79 for i in range(80)]
    found = scored.agg(F.percentile(score, F.array(*[F.lit(q) for q in at])).alias("t"))
    return found.select(F.explode("t").alias("threshold")).distinct()


def candidate_thresholds(scored: DataFrame, score: str = "score", default: float = 0.5) -> DataFrame:
    """A uniform grid, quantiles of the upper scores and the default."""
    at = [0.30 + (0.999 - 0.30) * i / 39 for i in range(40)]
    dense = scored.agg(F.percentile(score, F.array(*[F.lit(q) for q in at])).alias("t")).select(F.explode("t").alias("threshold"))
    spark = scored.sparkSession
    uniform = spark.createDataFrame([(round(i / 100, 2),) for i in range(1, 100)] + [(default,)], "threshold double")
    return dense.union(uniform).where("threshold is not null").distinct()


def band(runs: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    return runs.groupBy(*by).agg(
        F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("low"), F.max(value).alias("high")
    )


def summary(runs: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    return runs.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("worst"), F.max(value).alias("best")
    )


def head_to_head(runs: DataFrame, name: str, a: str, b: str, split: str, value: str, equal: float = 1e-12) -> DataFrame:
    """Wins of a, losses and ties over the splits that both have."""
    x = runs.where(F.col(name) == a).select(split, F.col(value).alias("x"))
    y = runs.where(F.col(name) == b).select(split, F.col(value).alias("y"))
    d = F.col("x") - F.col("y")
    return x.join(y, split).agg(
        F.count_if(d > equal).alias("wins"), F.count_if(d < -equal).alias("losses"), F.count_if(F.abs(d) <= equal).alias("ties")
    )


def sign_test(wins: int, losses: int) -> float:
    """Exact two-sided sign test; ties are left out, and without any win or loss p is 1."""
    n = wins + losses
    return min(1.0, 2 * sum(comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n) if n else 1.0


def lower_bound(successes: int, trials: int, confidence: float = 0.95) -> float:
    """One-sided exact lower bound of a share, found by halving on the binomial tail."""
    if not trials or not successes:
        return 0.0
    alpha = 1 - confidence
    if successes >= trials:
        return alpha ** (1 / trials)

    def tail(p: float) -> float:  # chance of so many successes or more
        return sum(comb(trials, i) * p**i * (1 - p) ** (trials - i) for i in range(successes, trials + 1))

    low, high = 0.0, successes / trials
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) < alpha else (low, mid)
    return (low + high) / 2


def true_rate(pairs: DataFrame, flag: str, truth: str = "is_match") -> DataFrame:
    """How many pairs have each value of a flag, and the share of true ones among them."""
    return pairs.groupBy(F.col(flag).alias("flag")).agg(F.count("*").alias("pairs"), F.avg(F.col(truth).cast("double")).alias("true_rate"))


def totals(runs: DataFrame, by: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Sums over splits; ``share`` of the last column in the first is null where there is nothing to divide by."""
    sums = runs.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])
    return sums.withColumn("share", F.try_divide(F.col(columns[-1]), F.col(columns[0])))


def best_cut(scored: DataFrame, score: str = "cosine") -> DataFrame:
    """The threshold of a plain score with the best F1, of ``baseline_thresholds``; the smallest of equals."""
    return best_threshold(threshold_grid(scored, baseline_thresholds(scored, score), score))
