"""Features of a pair of records, as expressions over ``left_*`` and ``right_*`` columns."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import text as T

TRAINED = ("cosine", "sequence_ratio", "word_jaccard", "length_ratio", "same_category", "price_relative_diff")
CONSTRAINTS = ("volume_conflict",)
DIAGNOSTIC = ("volume_match", "volume_one_sided")
#: For records whose fields may be missing.
TRAINED_MISSING = (
    "cosine", "sequence_ratio", "word_jaccard", "length_ratio", "price_relative_diff", "price_known",
    "description_jaccard", "manufacturer_in_name", "manufacturer_known",
)
DIAGNOSTIC_MISSING = ("description_known",)


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """The matcher has no equal among built-in expressions and depends on the order of its sides."""
    known: dict[tuple, float] = {}  # equal pairs of a batch are compared once
    for pair in zip(left, right):
        if pair not in known:
            known[pair] = SequenceMatcher(None, pair[0] or "", pair[1] or "").ratio()
    return pd.Series([known[pair] for pair in zip(left, right)], dtype="float64")


def set_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def same_category(a: Column, b: Column) -> Column:
    """Blank means unknown, which is no agreement."""
    return flag((a != "") & (b != "") & (a == b))


def price_relative_diff(a: Column, b: Column) -> Column:
    """Null where a price is missing."""
    return F.abs(a - b) / F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b, F.lit(0.01)))


def volume_features(left_title: Column, right_title: Column) -> dict[str, Column]:
    a, b = T.volumes(left_title), T.volumes(right_title)
    stated, overlap = (F.size(a) > 0) & (F.size(b) > 0), F.arrays_overlap(a, b)
    return {
        "volume_conflict": flag(stated & ~overlap),
        "volume_match": flag(stated & overlap),
        "volume_one_sided": flag((F.size(a) > 0) != (F.size(b) > 0)),
    }


def plain(left: str = "left_", right: str = "right_") -> dict[str, Column]:
    """For records with key, title, category and price; ``cosine`` comes from blocking."""
    a, b = (lambda c: F.col(left + c)), (lambda c: F.col(right + c))
    return {
        "sequence_ratio": sequence_ratio(a("key"), b("key")),
        "word_jaccard": set_jaccard(T.word_set(a("key")), T.word_set(b("key"))),
        "length_ratio": length_ratio(a("key"), b("key")),
        "same_category": same_category(a("category"), b("category")),
        "price_relative_diff": price_relative_diff(a("price"), b("price")),
    } | volume_features(a("title"), b("title"))


def with_missing(left: str = "left_", right: str = "right_") -> dict[str, Column]:
    """For records with key, key_spaced, price, description and manufacturer, any of them missing."""
    a, b = (lambda c: F.col(left + c)), (lambda c: F.col(right + c))
    price = price_relative_diff(a("price"), b("price"))
    x, y = T.token_set(a("description")), T.token_set(b("description"))
    described = (F.size(x) > 0) & (F.size(y) > 0)
    maker = T.squashed_key(F.coalesce(b("manufacturer"), F.lit("")))
    return {
        "sequence_ratio": sequence_ratio(a("key"), b("key")),
        "length_ratio": length_ratio(a("key"), b("key")),
        "word_jaccard": set_jaccard(T.token_set(a("key_spaced")), T.token_set(b("key_spaced"))),
        "price_relative_diff": price,
        "price_known": flag(price.isNotNull()),
        "description_jaccard": F.when(described, set_jaccard(x, y)),
        "description_known": flag(described),
        "manufacturer_in_name": F.when(maker != "", flag(a("key").contains(maker))),
        "manufacturer_known": flag(maker != ""),
    }
