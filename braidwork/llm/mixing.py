"""Mixing sources to target weights: Poisson replication.

A source with a share of the rows and a target weight has a mean repetition rate, weight times all rows
over its own rows. Each document draws its number of copies from the Poisson distribution of that mean
by inverting it at a number that a seeded hash of its id gives, so the mixture is the same on every run
and any split of the work. Copies are then dealt over all partitions by another hash. All steps are
DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, stored, table

SEED = "mix-1"
#: Means beyond this are drawn as a sum of equal parts, so that exp(-mean) stays far from 0.
MAX_MEAN = 64.0
#: Up to so many sources, their rates, 2 KB each at most, are broadcast; beyond, they are joined by a shuffle.
MAX_SOURCES = 5_000


def _hex(*parts) -> Column:
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.md5(F.concat_ws("|", *texts))


def unit(*parts) -> Column:
    """A number from 0 to 1 (exclusive): the first 52 bits of an MD5."""
    return F.conv(F.substring(_hex(*parts), 1, 13), 16, 10).cast("double") / float(1 << 52)


def cumulated(mean: Column) -> Column:
    """Poisson probabilities of at most 0, 1, 2 ... copies, as far as doubles can tell them from 1."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))
    top = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")

    def step(acc, k):
        p = acc["p"] * mean / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["all"])


def rates(docs: DataFrame, source: str, weights: dict[str, float] | None) -> DataFrame:
    """A row per source: its share of the target (equal shares where ``weights`` is None) and its mean.

    Sources without a weight get none and vanish; weights of absent sources are left out and the others
    scaled to sum to 1.
    """
    counts = docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("rows"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("_source") == name, F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    total = counts.agg(F.sum("weight").alias("_weights"), F.sum("rows").alias("_rows"))
    found = counts.join(F.broadcast(total)).withColumn(
        "mean", F.when(F.col("_weights") > 0, F.col("weight") / F.col("_weights") * F.col("_rows") / F.col("rows")).otherwise(0.0)
    )
    parts = F.greatest(F.ceil(F.col("mean") / MAX_MEAN), F.lit(1)).cast("int")
    return found.select("_source", "mean", parts.alias("_parts"), cumulated(F.col("mean") / parts).alias("_cdf"), "rows")


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, seed: str = SEED, source: str = "source", doc_id: str = "doc_id"
) -> DataFrame:
    """``docs`` with each row repeated as drawn, and ``n_copies``, ``copy`` (from 1) and ``shuffle_key``.

    A null source is a source of its own; rows without an id share one draw; repeated rows are drawn
    alike; an empty table stays empty. Texts are not looked at. Rows are spread over the partitions and
    sorted in them by ``shuffle_key``. A column of ``docs`` named as one of these three is replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c not in {"n_copies", "copy", "shuffle_key"}])
    found = rates(docs, source, weights)
    # A null source is a source too, so sources are compared by a name that is never null.
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    found = stored(found.select(name("_source").alias("_name"), "_parts", "_cdf", "rows"), "rates")
    named = docs.withColumn("_name", name(source))
    if found.count() <= MAX_SOURCES:
        drawn = named.join(F.broadcast(found.drop("rows")), "_name")
    else:
        drawn = join_hot(named, found, "_name", "rows", docs.count(), [doc_id])
    key = F.col(doc_id)
    draws = F.transform(
        F.sequence(F.lit(1), F.col("_parts")),
        lambda j: F.size(F.filter("_cdf", lambda c: c < unit(seed, key, j))),
    )
    n = F.aggregate(draws, F.lit(0), lambda a, b: a + b)
    drawn = drawn.withColumn("n_copies", n)
    rows = drawn.where("n_copies > 0").select(
        *docs.columns, "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy")
    )
    rows = rows.withColumn("shuffle_key", _hex(seed, F.lit("order"), key, F.col("copy")))
    return rows.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "source", "n_copies", "copy", "shuffle_key", "text")


OP7_SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
means AS (
  SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM counts) * (SELECT sum(n) FROM counts)::DOUBLE / n AS mean FROM counts
),
poisson AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM means
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM poisson
  WHERE k < ceil(mean + 12 * sqrt(mean) + 24)
),
drawn AS (
  SELECT d.doc_id, d.source, d.text,
    (SELECT count(*) FROM poisson q WHERE q.source IS NOT DISTINCT FROM d.source
      AND q.c < ('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, 'null') || '|1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
    )::INTEGER AS n_copies
  FROM documents d
)
SELECT doc_id, source, n_copies, copy::INTEGER AS copy,
  md5('mix-1|order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy) AS shuffle_key, text
FROM drawn, unnest(range(1, n_copies + 1)) AS r(copy)
"""
