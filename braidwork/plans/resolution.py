"""A whole resolution run: catalogues into the store, out of it, matched, decided, audited, and entities written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities, experiments, metrics, model
from ..operators.lineage import stored
from ..operators.policy import POLICIES, policy
from ..operators.store import Store, read_truth

#: Which policy's entities are written.
WRITTEN = "mutual best"
PRICE = {"left": "price", "right": "price"}


def run(store: Store, left_source: str, right_source: str, labels: DataFrame, k: int = 5, threshold: float = 0.5, seed=0, written: str = WRITTEN) -> DataFrame:
    """What closing the pairs of each policy gives, and writes the entities of one of them.

    ``labels`` name external ids. The model is fitted on the training fold; pairs of all records compete for
    each other; precision, recall and F1 are of the test fold, entities and buckets of all records, so the
    latter are optimistic. A row per policy.
    """
    policy(written)
    left, right = store.source(left_source, "left_id", "price"), store.source(right_source, "right_id", "price")
    record = store.read("record")
    known = stored(read_truth(labels, record, left_source, right_source), "truth")
    pairs = stored(experiments.pair_table(left, right.withColumn("title", F.col("title")), known, k), "pairs")
    rows, _ = experiments.scored(pairs, seed)
    rows = stored(rows, "scored")
    sources = record.where(F.col("source").isin(left_source, right_source)).select("record_id", "source", "title")
    true = entities.resolve(sources, known)
    parts = []
    for name in POLICIES:
        decided = POLICIES[name](rows, threshold)
        accepted = decided.where("keep")
        found = stored(entities.resolve(sources, accepted), "entities")
        audit = entities.closure_audit(found, accepted, decided, true, sources)
        buckets = audit.agg(
            *[F.sum(F.when(F.col("bucket") == b, F.col("pairs")).otherwise(0)).alias(c) for c, b in (
                ("accepted_pairs", "accepted by the matcher"), ("below_bar", "scored, below the bar"), ("never_met", "never a candidate"),
            )], F.coalesce(F.sum("same_source"), F.lit(0)).alias("same_source"),
        )
        exact = entities.exact_entities(found, true).agg(F.count("*").alias("entities"), F.count_if("exact").alias("exact"))
        run_of = metrics.confusion(decided.where("fold = 'test'")).join(F.broadcast(buckets)).join(F.broadcast(exact))
        parts.append(run_of.withColumn("policy", F.lit(name)))
        if name == written:
            store.write_entities(found)
    store.check()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_tables(spark: SparkSession, folder: str, left: DataFrame, right: DataFrame, truth: DataFrame) -> DataFrame:
    """``run`` over two tables with left_id or right_id, title, category and price, loaded into a store in ``folder``."""
    store = Store(spark, folder)
    mapping = {"title": "title", "category": "category", "price": "price"}
    store.load(left, "left", mapping, "left_id")
    store.load(right, "right", mapping, "right_id")
    return run(store, "left", "right", truth)
