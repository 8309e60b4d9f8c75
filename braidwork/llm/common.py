"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.lineage import checkpoint_dir, released, stored

#: A key of more than this part of all rows is hot.
HOT = 1 / 4096
#: Bytes of texts that a Python worker takes from a batch at a time.
SLICE = 1 << 20
#: What an Arrow batch holds, and Spark's limit where none is named.
BATCH, DEFAULT_BATCH = "4m", "67108864b"

__all__ = ["checkpoint_dir", "join_hot", "literal_doubles", "map_texts", "released", "slices", "small_batches", "stored", "table", "text_or_empty", "window_hashes", "words"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Has Arrow batches hold ``BATCH`` instead of Spark's own limit; a limit that the session names stays.

    Texts are long, and both sides hold batches outside the heap. ``table`` and ``map_texts`` see to it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == DEFAULT_BATCH:
        spark.conf.set(key, BATCH)


def words(text: Column | str) -> Column:
    """The words of a text in order; null and empty texts have none.

    White space other than blanks is rare, so it is turned into blanks first: splitting at one fixed
    character needs no pattern.
    """
    return F.array_remove(F.split(F.regexp_replace(text_or_empty(text), r"[\x09-\x0D]", " "), " "), "")


def join_hot(rows: DataFrame, other: DataFrame, key: str, n: str, total: int, spread: list[str]) -> DataFrame:
    """``rows`` with the columns of ``other`` (left join), which has a row per key and in ``n`` how many rows have it.

    Keys of more than a ``HOT`` part of all ``total`` rows, which can't be more than its inverse, are
    broadcast. The others meet in a shuffle, where rows that are done go each to a place of its own by
    their ``spread`` columns, so no key gathers many rows in a task.
    """
    added = [c for c in other.columns if c not in (key, n)]
    hot = other.where(F.col(n) > total * HOT).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in added])
    cold = other.where(F.col(n) <= total * HOT).select(
        F.col(key).alias("_cold"), F.lit(0).cast("bigint").alias("_place"), *[F.col(c).alias(f"_cold_{c}") for c in added]
    )
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    done = F.col("_hot").isNotNull()
    found = found.withColumn("_key", F.when(~done, F.col(key))).withColumn(
        "_spot", F.when(done | F.col(key).isNull(), F.xxhash64(*spread)).otherwise(F.lit(0).cast("bigint"))
    )
    found = found.join(cold, (F.col("_key") == F.col("_cold")) & (F.col("_spot") == F.col("_place")), "left")
    return found.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in added])


def text_or_empty(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text, F.lit(""))


def window_hashes(hashes: Column, size: int) -> Column:
    """One hash per run of ``size`` entries; an empty array where the array is shorter."""
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (size - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, size)]))


def literal_doubles(values) -> Column:
    """A constant array column; parsed once by constant folding, so plans stay small."""
    return F.from_json(F.lit("[" + ",".join(repr(float(v)) for v in values) + "]"), "array<double>")


def give_back() -> None:
    """Hands memory that a task has freed back to the system: workers live on, and others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def slices(batch: pa.RecordBatch, at: int, most: int = SLICE):
    """The batch in parts with about ``most`` bytes of column ``at`` each: what Python holds at a time."""
    n = batch.num_rows
    step = max(1, n * most // max(most, batch.column(at).nbytes)) if n else 1
    for i in range(0, n, step):
        yield batch.slice(i, step)


def map_texts(docs: DataFrame, text: str, f, made: str, keep: list[str] | None = None) -> DataFrame:
    """Adds columns that Python works out from whole texts, batch by batch.

    ``f`` gets a list of texts (None for null) and returns a list of values for each column of the schema
    ``made``. Other columns pass through as Arrow data, so ids keep their type and their nulls.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    schema = T._parse_datatype_string(made)
    kept = [F.col(c) for c in keep]
    # A text that is kept anyway is sent once.
    source = docs.select(*kept) if text in keep else docs.select(*kept, F.col(text).alias("_mapped_text"))
    at = keep.index(text) if text in keep else len(keep)
    types = [to_arrow_type(x.dataType) for x in schema]
    names = [*keep, *[x.name for x in schema]]

    def mapped(batches):
        for b in batches:
            for part in slices(b, at):
                found = f(part.column(at).to_pylist())
                new = [pa.array(v, type=t) for v, t in zip(found, types)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *new], names=names)
                del found, new, part
        give_back()

    return source.mapInArrow(mapped, T.StructType([*source.schema.fields[: len(keep)], *schema.fields]))
