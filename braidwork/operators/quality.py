"""Cleaning of raw records and the rules that guard what is written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .blocking import Refused

#: Fixed limits of the rules.
MAX_MISSING, MAX_DISAGREE, MAX_EMPTY, SPREAD = 0.02, 0.05, 0.5, 0.005
GUARDED = ("rating_stars", "price_listing_gbp", "price_incl_tax_gbp", "stock_count")
PRICES = ("price_listing_gbp", "price_excl_tax_gbp", "price_incl_tax_gbp")


def clean(raw: DataFrame) -> DataFrame:
    """Raw strings to 15 typed columns, in one projection."""
    description = F.trim(F.coalesce(F.col("description"), F.lit("")))
    stock = T.stock_count("stock")
    return raw.select(
        F.trim("title").alias("title"), T.spaced_key("title").alias("title_key"), "category", "upc",
        T.rating_stars("rating").alias("rating_stars"), T.money("price").alias("price_listing_gbp"),
        T.money("price_excl_tax").alias("price_excl_tax_gbp"), T.money("price_incl_tax").alias("price_incl_tax_gbp"),
        T.money("tax").alias("tax_gbp"), stock.alias("stock_count"), T.in_stock(stock).alias("in_stock"),
        T.number("review_count", "int").alias("review_count"), description.alias("description"),
        T.word_count(description).alias("description_words"), "detail_url",
    )


def is_close(a, b):
    """As near as 1e-8 and a hundred-thousandth of the second value."""
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def validate(frame: DataFrame) -> DataFrame:
    """(rule, value, rows, limit, ok): all rules of cleaned records in one pass."""
    listing, excl, tax, incl = (F.col(c) for c in ("price_listing_gbp", "price_excl_tax_gbp", "tax_gbp", "price_incl_tax_gbp"))
    n = F.count("*")
    aggregates = [F.count_if(F.col(c).isNull()).alias(f"missing {c}") for c in GUARDED]
    aggregates += [
        F.count_if(~is_close(listing, incl)).alias("listing and detail price"),
        F.count_if(listing.isNotNull() & incl.isNotNull()).alias("_both"),
        F.count_if(~is_close(excl + tax, incl)).alias("excl + tax = incl"),
        F.count_if((excl + tax + incl).isNotNull()).alias("_triple"),
        n.alias("_n"),
    ]
    rules = [(f"missing {c}", "_n", MAX_MISSING) for c in GUARDED]
    rules += [("listing and detail price", "_both", MAX_DISAGREE), ("excl + tax = incl", "_triple", 0.0)]
    if "description" in frame.columns:
        aggregates.append(F.count_if(F.length(F.coalesce(F.col("description"), F.lit(""))) == 0).alias("empty description"))
        rules.append(("empty description", "_n", MAX_EMPTY))
    row = frame.agg(*aggregates)
    parts = [
        F.struct(F.lit(r).alias("rule"), F.col(r).alias("value"), F.col(of).alias("rows"), F.lit(limit).alias("limit"))
        for r, of, limit in rules
    ]
    out = row.select(F.inline(F.array(*parts)))
    return out.withColumn("ok", F.col("value") <= F.col("limit") * F.col("rows"))


def gate(report: DataFrame) -> None:
    """Refuses to go on while a rule is broken."""
    broken = [r["rule"] for r in report.where("not ok").collect()]
    if broken:
        raise Refused(f"not written, rules broken: {broken}")


def null_rates(frame: DataFrame, columns: Sequence[str], limit: float = MAX_MISSING) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("missing"), F.count("*").alias("rows")) for c in columns]
    rows = frame.agg(F.array(*parts).alias("a")).select(F.inline("a"))
    return rows.withColumn("ok", F.col("missing") <= limit * F.col("rows"))


def column_profile(frame: DataFrame, columns: Sequence[str] | None = None, order: str | None = None) -> DataFrame:
    """column, blanks (null or empty) and their share, distinct values, longest text and an example.

    The example is the first value by ``order`` that isn't blank; without an order, the smallest one.
    """
    columns = columns or frame.columns
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    first = F.col(order) if order else F.lit(None).cast("int")
    cells = F.array(*[F.struct(F.lit(i).alias("i"), text(c).alias("value"), first.alias("first")) for i, c in enumerate(columns)])
    # Values are counted where they are dealt by, so no task holds those of a column.
    values = frame.select(F.inline(cells)).groupBy("i", "value").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    filled = F.col("value").isNotNull()
    found = values.groupBy("i").agg(
        F.sum("n").alias("rows"), F.sum(F.when(~filled, F.col("n")).otherwise(0)).alias("blank"), F.count("value").alias("distinct"),
        F.max(F.length("value")).alias("longest"), F.min(F.when(filled, F.col("first"))).alias("first"),
    )
    known = values.where(filled)
    if order:
        known = known.join(F.broadcast(found.select("i", "first")), ["i", "first"])
    example = known.groupBy("i").agg(F.min("value").alias("example"))
    names = frame.sparkSession.createDataFrame(list(enumerate(columns)), "i int, column string")
    rows = names.join(F.broadcast(found), "i", "left").join(F.broadcast(example), "i", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select("column", none("blank"), F.try_divide("blank", "rows").alias("blank_share"), none("distinct"), none("longest"), "example")


def constant_columns(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns whose values, nulls apart, are all the same."""
    columns = columns or frame.columns
    parts = [
        F.struct(F.lit(c).alias("column"), F.min(F.col(c).cast("string")).alias("value"), F.max(F.col(c).cast("string")).alias("_to"))
        for c in columns
    ]
    rows = frame.agg(F.array(*parts).alias("a")).select(F.inline("a"))
    return rows.where(F.col("value") == F.col("_to")).select("column", "value")


def description_profile(frame: DataFrame) -> DataFrame:
    size = F.length(F.coalesce(F.col("description"), F.lit("")))
    return frame.agg(
        F.count_distinct("category").alias("categories"), F.min("price_listing_gbp").alias("price_low"),
        F.max("price_listing_gbp").alias("price_high"), F.avg("price_listing_gbp").alias("price_mean"),
        F.count_if(size == 0).alias("without_description"), F.avg(size).alias("description_mean"),
        F.max(size).alias("description_longest"), F.min(F.when(size > 0, size)).alias("description_shortest"),
    )


def empty_fields(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, empty, records; no record at all counts as a failure of every field."""
    parts = [
        F.struct(F.lit(f).alias("field"), F.count_if(F.coalesce(F.col(f), F.lit("")) == "").alias("empty"), F.count("*").alias("records"))
        for f in fields
    ]
    rows = records.agg(F.array(*parts).alias("a")).select(F.inline("a"))
    return rows.withColumn("ok", (F.col("empty") == 0) & (F.col("records") > 0))


def price_spread(frame: DataFrame, key: str, columns: Sequence[str] = PRICES) -> DataFrame:
    """One row: how many rows have prices further apart than half a penny, and the worst of them."""
    prices = [F.col(c).cast("double") for c in columns if c in frame.columns]
    if len(prices) < 2:
        raise Refused("a price audit needs two price columns")
    spread = F.greatest(*prices) - F.least(*prices)
    rows = frame.select(F.col(key).alias("key"), spread.alias("spread"))
    return rows.agg(
        F.count_if(F.col("spread") > SPREAD).alias("disagreeing"), F.max("spread").alias("worst"),
        F.max_by("key", F.struct("spread", "key")).alias("worst_key"),
    )


def review_columns(found: Sequence[str], mapping: dict[str, str], key: str, ignored: dict[str, str]) -> dict[str, list[str]]:
    """Each column of a source is stored, explained or the key; the rest is named."""
    return {
        "stored": [c for c in mapping if c in found],
        "absent": [c for c in mapping if c not in found],
        "key": [key] if key in found and key not in mapping else [],
        "explained": [c for c in sorted(ignored) if c in found],
        "unexplained": [c for c in found if c not in mapping and c not in ignored and c != key],
    }


def check_unique(frame: DataFrame, key: str) -> None:
    if frame.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").head(1):
        raise Refused(f"{key} isn't unique")


def label_integrity(truth: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: labels, those with both ends, their share of all pairs, records without and with several partners on each side."""
    t = truth.select("left_id", "right_id").distinct()
    both = t.join(left.select("left_id").distinct(), "left_id", "left_semi").join(right.select("right_id").distinct(), "right_id", "left_semi")

    def side(records: DataFrame, c: str, s: str) -> DataFrame:
        partners = records.select(c).distinct().join(t.groupBy(c).agg(F.count("*").alias("n")), c, "left")
        return partners.agg(F.count_if(F.col("n").isNull()).alias(f"{s}_alone"), F.count_if(F.col("n") > 1).alias(f"{s}_several"))

    return (
        t.agg(F.count("*").alias("labels"))
        .join(F.broadcast(both.agg(F.count("*").alias("resolvable"))))
        .join(F.broadcast(left.agg(F.count("*").alias("_lefts"))))
        .join(F.broadcast(right.agg(F.count("*").alias("_rights"))))
        .withColumn("positive_rate", F.try_divide(F.col("labels"), F.col("_lefts") * F.col("_rights")))
        .drop("_lefts", "_rights")
        .join(F.broadcast(side(left, "left_id", "left")))
        .join(F.broadcast(side(right, "right_id", "right")))
    )
