"""Connected components over an edge table, by alternating large-star and small-star rounds.

Each round is two shuffles on a vertex. What a vertex is linked to is aggregated before it is moved; its
edges then meet that value in a join, which adaptive execution splits where one vertex has very many. The number of rounds grows with the logarithm of the
longest chain (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import released, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links each neighbour of a vertex to the smallest vertex around it; ``large``: only larger neighbours move."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    moved = linked.where("v > u") if large else linked
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str, limit: int = 60) -> DataFrame:
    """A row per vertex of ``edges`` with ``component``, the smallest vertex that it reaches.

    Null ends and self-loops are left out; an empty table gives an empty result.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    now = stored(now, "edges")
    for _ in range(limit):
        after = stored(_stars(_stars(now, True), False), "edges")
        same = after.join(now, ["u", "v"], "left_semi").count()
        done = same == after.count() == now.count()
        released(now)
        now = after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle within {limit} rounds")
    roots = now.select(F.col("v").alias("u")).distinct().withColumn("component", F.col("u"))
    return now.select("u", F.col("v").alias("component")).union(roots).distinct().withColumnRenamed("u", "vertex")
