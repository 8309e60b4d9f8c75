"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text.

Word 1-grams and 2-grams are hashed into a fixed number of buckets. Two multinomials over the
buckets are counted, one over every document and one over the trusted documents; a document's
score is the mean log-ratio of its n-grams, so its length cancels out. Every document meets the
same fixed threshold. All steps are DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import literal_doubles, table, text_or_empty, window_hashes, words

BUCKETS = 1 << 16
SMOOTHING = 1.0
MIN_SCORE = -0.15
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


def repeat_words(windows: Column, distinct: Column, size: int = REPEAT_WINDOW) -> Column:
    """Words inside windows that occur twice or more, given the hash of each window.

    Windows are sorted by hash so equal ones are neighbours; the positions of those are put back in
    order and every position adds the words up to the next one, at most a window.
    """
    pairs = F.sort_array(F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    same = lambda p, q: F.coalesce(p["g"] == q["g"], F.lit(False))
    repeated = lambda a: F.filter(a, lambda p, i: same(p, F.get(a, i - 1)) | same(p, F.get(a, i + 1)))
    covered = lambda a: F.aggregate(
        F.transform(a, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(a, i + 1) - x, F.lit(size)))).cast(
            "array<bigint>"
        ),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x,
    )
    # Arrays that are bound to a lambda's argument are made once, not once per element.
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    at = bound(pairs, lambda a: F.sort_array(F.transform(repeated(a), lambda p: p["i"])))
    return F.when(F.size(distinct) == F.size(windows), F.lit(0).cast("bigint")).otherwise(bound(at, covered))


def base_rules(docs: DataFrame, text: str, *keys: str) -> DataFrame:
    """A row per document: ``keys``, its words and what is counted without looking at single words."""
    lines = F.filter(F.split(text_or_empty(text), "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    out = docs.withColumn("_words", words(text)).withColumn("_lines", lines)
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    out = out.withColumn("_windows", window_hashes(F.col("_hashes"), REPEAT_WINDOW))
    out = out.withColumn("_distinct", F.array_distinct("_windows"))
    return out.select(
        *keys,
        "_words",
        F.length(F.regexp_replace(text_or_empty(text), f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("_windows"), F.col("_distinct")).alias("n_repeat_words"),
    )


def exploded(docs: DataFrame, *keys: str, words_at: str = "_words") -> DataFrame:
    """A row per word ``a`` with the next word ``b``; one row of nulls for a document without words."""
    n = F.size(words_at)
    pairs = F.arrays_zip(F.col(words_at).alias("a"), F.slice(words_at, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))
    return docs.select(*keys, F.inline_outer(pairs).alias("a", "b"))


def bucket(n: int, *parts: str) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(n)).cast("int")


def fit_ratio(docs: DataFrame, trusted: str, text: str = "text", n: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """Log-ratio of each bucket; ``trusted`` names a boolean column of ``docs``.

    Counts cover all documents. What comes to the driver is ``n`` rows at any input size.
    With no trusted document every ratio is 0.
    """
    found = docs.select(F.coalesce(F.col(trusted), F.lit(False)).cast("int").alias("_t"), words(text).alias("_words"))
    rows = (
        exploded(found, "_t")
        .where("a is not null")
        .select("_t", F.explode(F.array(bucket(n, "a"), F.when(F.col("b").isNotNull(), bucket(n, "a", "b")))).alias("k"))
        .where("k is not null")
        .groupBy("k")
        .agg(F.count("*").alias("raw"), F.sum("_t").alias("target"))
        .collect()
    )
    raw, target = [0] * n, [0] * n
    for r in rows:
        raw[r["k"]], target[r["k"]] = r["raw"], r["target"]
    total_raw, total_target = sum(raw) + smoothing * n, sum(target) + smoothing * n
    if not sum(target):
        return [0.0] * n
    return [math.log((t + smoothing) / total_target) - math.log((r + smoothing) / total_raw) for t, r in zip(target, raw)]


def quality_rules(
    docs: DataFrame, trusted_ids: DataFrame, text: str = "text", doc_id: str = "doc_id",
    n: int = BUCKETS, min_score: float = MIN_SCORE,
) -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, base counts, ``llr`` and ``kept``.

    ``trusted_ids`` has the trusted documents' ``doc_id``s; a join marks all their texts, by
    a shuffle where the ids are many, and both counts cover every document that they are of. Null and empty texts have no words, an
    ``llr`` of 0, and fail the base rules; repeated rows are judged alike; an empty table gives an
    empty result; other columns of ``docs``, whatever their names, are not read.

    A document's n-grams are scored where it is read; its sums are the only rows that move.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    ids = trusted_ids.select(F.col(doc_id).alias("_id")).where("_id is not null").distinct().withColumn("_trusted", F.lit(True))
    # Rows without an id would all meet in one task of a shuffle.
    # The ids are always met in a shuffle: what a small table would save by a broadcast, a large one can't.
    marked = docs.where("doc_id is not null").join(ids.hint("merge"), F.col("doc_id") == F.col("_id"), "left").select("_text", "_trusted")
    marked = marked.unionByName(docs.where("doc_id is null").select("_text", F.lit(False).alias("_trusted")))
    ratio = fit_ratio(marked, "_trusted", "_text", n)
    weights = literal_doubles(ratio)
    keys = ["_row", "doc_id", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = base_rules(docs.withColumn("_row", F.monotonically_increasing_id()), "_text", "_row", "doc_id")
    zero = F.lit(0.0)
    ratios = F.when(F.col("a").isNotNull(), F.get(weights, bucket(n, "a"))).otherwise(zero)
    ratios = ratios + F.when(F.col("b").isNotNull(), F.get(weights, bucket(n, "a", "b"))).otherwise(zero)
    counted = exploded(rows, *keys).groupBy(*keys).agg(
        F.count("a").alias("n_words"),
        F.coalesce(F.sum(F.length("a")), F.lit(0)).cast("bigint").alias("word_chars"),
        F.sum(ratios).alias("_sum"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    llr = F.when(F.col("n_words") > 0, F.col("_sum") / (2 * F.col("n_words") - 1)).otherwise(zero)
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (llr >= min_score)).alias("kept"), llr.alias("llr"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules(docs, trusted)
