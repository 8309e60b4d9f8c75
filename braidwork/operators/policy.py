"""From scores to decisions: which candidate pairs are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(by: list[str], score: str, ties: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), *ties)) == 1


def threshold_only(pairs: DataFrame, threshold, score: str = "score", scope: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``keep``: score at or above the threshold, a number or a column."""
    return pairs.withColumn("keep", F.coalesce(F.col(score) >= threshold, F.lit(False)))


def best_per_right(pairs: DataFrame, threshold, score: str = "score", scope: tuple[str, ...] = ()) -> DataFrame:
    """Keeps a right record's best pair if it reaches the threshold; ties go to the first neighbour."""
    ties = [c for c in ("seq", "left_id") if c in pairs.columns]
    best = _first([*scope, "right_id"], score, ties)
    return pairs.withColumn("_r", best).withColumn("keep", F.col("_r") & F.coalesce(F.col(score) >= threshold, F.lit(False))).drop("_r")


def mutual_best(pairs: DataFrame, threshold, score: str = "score", scope: tuple[str, ...] = ()) -> DataFrame:
    """Keeps pairs that are the best of both their sides.

    ``scope`` names columns (a split, a fold) within which pairs compete; without it all pairs do.
    """
    ties = [c for c in ("seq", "left_id") if c in pairs.columns]
    rows = pairs.withColumn("_r", _first([*scope, "right_id"], score, ties)).withColumn("_l", _first([*scope, "left_id"], score, ["right_id"]))
    return rows.withColumn("keep", F.col("_r") & F.col("_l") & F.coalesce(F.col(score) >= threshold, F.lit(False))).drop("_r", "_l")


POLICIES: dict[str, Callable[..., DataFrame]] = {
    "threshold only": threshold_only,
    "best per right": best_per_right,
    "mutual best": mutual_best,
}


def policy(name: str) -> Callable[..., DataFrame]:
    from .blocking import Refused

    if name not in POLICIES:
        raise Refused(f"no policy {name!r}; there are {sorted(POLICIES)}")
    return POLICIES[name]


def veto(score: Column, conflict: Column) -> Column:
    """A stated conflict makes a score 0, any other pair keeps its own."""
    return F.when(conflict == 1.0, F.lit(0.0)).otherwise(score)


def discordant(keep_a: DataFrame, keep_b: DataFrame, truth: str = "is_match") -> DataFrame:
    """Pairs that exactly one of two runs decides wrongly: ``change`` is fixed (by b) or broken."""
    a = keep_a.select("left_id", "right_id", (F.col("keep") != (F.col(truth) == 1)).alias("wrong_a"))
    b = keep_b.select("left_id", "right_id", (F.col("keep") != (F.col(truth) == 1)).alias("wrong_b"))
    both = a.join(b, ["left_id", "right_id"]).where(F.col("wrong_a") != F.col("wrong_b"))
    return both.select("left_id", "right_id", F.when(F.col("wrong_a"), "fixed").otherwise("broken").alias("change"))


def triage(decided: DataFrame, truth: DataFrame, threshold: float, top: int = 8, score: str = "score") -> DataFrame:
    """The ``top`` pairs by score of each kind of error; ``decided`` has score, is_match and keep."""
    ids = ["left_id", "right_id"]
    never = truth.select(*ids).distinct().join(decided, ids, "left_anti").select(*ids, F.lit(None).cast("double").alias("score"))
    kinds = {
        "never generated": never,
        "too low": decided.where((F.col("is_match") == 1) & (F.col(score) < threshold)),
        "false positive": decided.where((F.col("is_match") == 0) & (F.col(score) >= threshold)),
        "surviving": decided.where((F.col("is_match") == 0) & F.col("keep")),
    }
    out = None
    for kind, rows in kinds.items():
        rows = rows.select(*ids, F.col(score).alias("score")).orderBy(F.col(score).desc_nulls_last(), *ids).limit(top)
        rows = rows.select(F.lit(kind).alias("kind"), *ids, "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def shown(pairs: DataFrame, left: DataFrame, right: DataFrame, columns: tuple[str, ...] = ("title", "category", "price")) -> DataFrame:
    """Both records of each pair side by side, with all that the pair table has."""
    side = lambda df, s: df.select(f"{s}_id", *[F.col(c).alias(f"{s}_{c}") for c in columns if c in df.columns])
    return pairs.join(side(left, "left"), "left_id").join(side(right, "right"), "right_id")
