"""Which texts contain which passages, found by shared runs of words and then verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a run.
RUN = 3


def _runs(words: Column) -> Column:
    """A hash per run of ``RUN`` words; the words are split once, as they are bound to the argument of a lambda."""

    def of(w: Column) -> Column:
        starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (RUN - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, RUN)]))

    return F.get(F.transform(F.array(words), of), F.lit(0))


def contained(passages: DataFrame, texts: DataFrame, passage: str = "item", text: str = "text", passage_id: str = "item_id", text_id: str = "doc_id") -> DataFrame:
    """(passage_id, text_id) of all texts that contain a passage, once each.

    A passage's words but the first and the last, which may be cut, are words of every text that holds it:
    so a text and a passage meet by a run of such words. Passages too short to have one look at all texts;
    they are taken one text at a time and never paired with each other. Null texts and passages have no pair.
    """
    items = passages.select(F.col(passage_id).alias("_p"), F.col(passage).alias("_passage")).where("_passage is not null").distinct()
    rows = texts.select(F.col(text_id).alias("_t"), F.col(text).alias("_text")).where("_text is not null").distinct()
    inner = F.split("_passage", " ")
    run = F.get(_runs(F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0)))), F.lit(0))
    items = items.withColumn("_run", run)
    long, short = items.where("_run is not null"), items.where("_run is null")
    # Only ids and hashes are multiplied; texts are fetched for what met.
    met = rows.select("_t", F.explode(F.array_distinct(_runs(F.split("_text", " ")))).alias("_run")).join(long.select("_p", "_run"), "_run")
    met = met.select("_t", "_p").distinct()
    found = met.join(long, "_p").join(rows, "_t").where(F.contains("_text", "_passage")).select("_p", "_t")
    if short.head(1):
        few = short.agg(F.collect_set(F.struct("_p", "_passage")).alias("_few"))
        each = rows.join(F.broadcast(few)).select("_t", F.explode(F.filter("_few", lambda x: F.contains(F.col("_text"), x["_passage"]))).alias("_x"))
        found = found.union(each.select("_x._p", "_t"))
    return found.select(F.col("_p").alias(passage_id), F.col("_t").alias(text_id)).distinct()
