from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from braidwork.functions import features as X
from braidwork.functions import text as T


def values(spark, f, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    return [r["v"] for r in df.select("i", f("t").alias("v")).orderBy("i").collect()]


def test_cleaning(spark):
    assert values(spark, T.money, ["EUR 7.25", "¥1,200.5", "free", "  ", "3..4", None, "-8"]) == [7.25, 1200.5, None, None, None, None, 8.0]
    assert values(spark, T.stock_count, ["Shelf (107 available)", "(3  available)", "3 available", None]) == [107, 3, None, None]
    assert values(spark, T.spaced_key, ["Blue-Green\tLamp,  No. 9!", "blue green lamp no 9", None]) == ["blue green lamp no 9"] * 2 + [None]
    assert values(spark, T.squashed_key, ["Blue-Green Lamp, No. 9!"]) == ["bluegreenlampno9"]
    assert values(spark, T.split_key, ["XR7b-22 mk2", "nothing"]) == ["xr 7 b 22 mk 2", "nothing"]
    assert values(spark, T.word_count, ["\n", None, "one", " two\twords "]) == [0, 0, 1, 2]
    assert values(spark, T.rating_stars, ["Two", "Four", "FOUR", ""]) == [2, 4, None, None]
    assert values(spark, T.slug, ["https://h/shop/blue-lamp_9/index.html", "https://h", "/lamps/", "p?page=2", "a/" + "z" * 130]) == ["blue-lamp_9", "index", "lamps", "p", "z" * 120]


def test_volumes(spark):
    titles = ["Garden Atlas, Volume 12", "Atlas part 04 and Book 7", "No. 3 of no. 3", "2nd edition", "A notebook 5", None, "# 8", "vol.IX"]
    assert [sorted(v) for v in values(spark, T.volumes, titles)] == [[12], [4, 7], [3], [], [5], [], [8], []]


def test_pair_features(spark):
    row = ("garden atlas", "Garden Atlas, part 3", "maps", 8.0, "atlas garden maps", "Atlas: Garden maps, part 4", "", 10.0)
    names = [f"{s}_{c}" for s in ("left", "right") for c in ("key", "title", "category", "price")]
    df = spark.createDataFrame([row], names)
    got = df.select(*[c.alias(n) for n, c in X.plain().items()]).first()
    assert got["sequence_ratio"] == SequenceMatcher(None, row[0], row[4]).ratio()
    assert got["word_jaccard"] == pytest.approx(2 / 3) and got["length_ratio"] == pytest.approx(12 / 17)
    assert got["same_category"] == 0.0 and got["price_relative_diff"] == pytest.approx(0.2)
    assert (got["volume_conflict"], got["volume_match"], got["volume_one_sided"]) == (1.0, 0.0, 0.0)


def test_missing_features(spark):
    schema = ", ".join(f"{s}_{c} {t}" for s in ("left", "right") for c, t in (("key", "string"), ("key_spaced", "string"), ("price", "double"), ("description", "string"), ("manufacturer", "string")))
    rows = [
        ("acmedrill", "acme drill", None, "strong drill", "", "acmedrill", "acme drill", 1.0, "", "Acme"),
        ("drill9", "drill 9", 4.0, "a strong drill", "", "drill", "drill", 5.0, "a drill", ""),
    ]
    got = spark.createDataFrame(rows, schema).select("left_key", *[c.alias(n) for n, c in X.with_missing().items()]).orderBy("left_key").collect()
    a, b = got
    assert a["price_relative_diff"] is None and a["price_known"] == 0.0 and a["description_jaccard"] is None and a["description_known"] == 0.0
    assert (a["manufacturer_in_name"], a["manufacturer_known"]) == (1.0, 1.0) and (b["manufacturer_in_name"], b["manufacturer_known"]) == (None, 0.0)
    assert b["price_relative_diff"] == pytest.approx(0.2) and b["description_jaccard"] == pytest.approx(2 / 3) and b["word_jaccard"] == 0.5
    for r, x in zip(got, rows):
        assert r["sequence_ratio"] == SequenceMatcher(None, x[0], x[5]).ratio()
    empty = spark.createDataFrame([("", "")], "a string, b string").select(X.sequence_ratio("a", "b")).first()[0]
    assert empty == 1.0
