"""Cleaning expressions: columns in, columns out, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How ratings are written.
RATINGS = {"One": 1, "Two": 2, "Three": 3, "Four": 4, "Five": 5}
#: Fixed pattern: the marks before a volume number.
VOLUME = r"(?iu)(?:vol\.?|volume|book|part|no\.?|#)\s*(\d+)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(text: Column | str) -> Column:
    """Digits and points of a price as a number; null where they make none. Signs are lost."""
    return F.regexp_replace(col(text), "[^0-9.]", "").try_cast("double")


def stock_count(text: Column | str) -> Column:
    found = F.regexp_extract(col(text), r"\((\d+)\s+available\)", 1)
    return F.nullif(found, F.lit("")).try_cast("int")


def in_stock(count: Column | str) -> Column:
    return F.coalesce(col(count), F.lit(0)) > 0


def spaced_key(text: Column | str) -> Column:
    """Lower case, anything but a-z, 0-9 and blanks to a blank, single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", " "))


def squashed_key(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "")


def split_key(text: Column | str) -> Column:
    """``spaced_key`` with a blank wherever a letter and a digit meet."""
    key = F.trim(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", " "))
    return F.regexp_replace(key, "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ")


def rating_stars(text: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RATINGS.items() for x in pair])
    return F.try_element_at(table, col(text))


def number(text: Column | str, kind: str = "double") -> Column:
    return F.trim(col(text)).try_cast(kind)


def text_or_null(text: Column | str) -> Column:
    return F.nullif(F.trim(col(text)), F.lit(""))


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(F.trim(F.coalesce(col(text), F.lit(""))), r"\s+"), lambda w: w != ""))


def word_set(text: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), lambda w: w != ""))


def token_set(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)))


def volumes(title: Column | str) -> Column:
    """Numbers that a title marks as volumes, each once, without leading zeros."""
    found = F.regexp_extract_all(F.coalesce(col(title), F.lit("")), F.lit(VOLUME), F.lit(1))
    return F.array_distinct(F.array_compact(F.transform(found, lambda x: x.try_cast("bigint"))))


def title_of(title: Column | str, name: Column | str) -> Column:
    return F.coalesce(F.nullif(col(title), F.lit("")), F.nullif(col(name), F.lit("")), F.lit(""))


def slug(url: Column | str) -> Column:
    """The last path segment that names a page, at most 120 characters; ``index`` where there is none."""
    path = F.regexp_extract(col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), r"/index\.html$", "")
    last = F.element_at(F.split(path, "/"), -1)
    return F.left(F.coalesce(F.nullif(last, F.lit("")), F.lit("index")), F.lit(120))
