"""Incremental loads: each micro-batch is merged into the record table, which stays idempotent.

A batch that is run again offers the same keys with the same values, so it changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import Store


def upsert_stream(stream: DataFrame, store: Store, source: str, mapping: dict[str, str], key: str, checkpoint: str):
    """A query that loads a stream of raw rows; of rows with one key in a batch, the last by text order counts."""

    def load(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c != key]
        one = batch.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, "_r.*")
        if one.head(1):
            store.load(one, source, mapping, key)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
