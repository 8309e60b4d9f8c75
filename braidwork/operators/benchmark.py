"""A catalogue pair with known matches, made from one catalogue by seeded perturbation.

All choices are hashes of the record's id, so the benchmark is the same on any split of the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.model import uniform

SHARED, LEFT_ONLY = 0.60, 0.25
#: Words and their abbreviations.
ABBREVIATIONS = {"and": "&", "volume": "vol.", "first": "1st", "second": "2nd"}


def _words(title: Column) -> Column:
    return F.filter(F.split(title, r"\s+"), lambda w: w != "")


def drop_subtitle(title: Column) -> Column:
    return F.trim(F.get(F.split(title, r"[:(\[]", 2), F.lit(0)))


def swap_first_two_words(title: Column) -> Column:
    w = _words(title)
    swapped = F.concat(F.slice(w, 2, 1), F.slice(w, 1, 1), F.slice(w, F.lit(3), F.greatest(F.size(w) - 2, F.lit(0))))
    return F.array_join(F.when(F.size(w) >= 2, swapped).otherwise(w), " ")


def typo(title: Column, where: Column, which: Column) -> Column:
    """One inner character dropped or changed with the next; titles of under four characters stay."""
    n = F.length(title)
    at = (F.lit(2) + F.floor(where * (n - 2))).cast("int")  # from 1
    part = lambda a, k: F.substring(title, a, k)
    rest = part(at + 2, n)
    dropped = F.concat(part(F.lit(1), at - 1), part(at + 1, n))
    crossed = F.concat(part(F.lit(1), at - 1), part(at + 1, F.lit(1)), part(at, F.lit(1)), rest)
    return F.when(n < 4, title).when(which < 0.5, dropped).otherwise(crossed)


def abbreviate(title: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.transform(_words(title), lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w)), " ")


def strip_punctuation(title: Column) -> Column:
    return F.regexp_replace(title, r"(?U)[^\w\s]", "")


def perturb_title(title: Column, key: Column, seed=0) -> Column:
    """One to three of five changes, in hashed order; a title that they would empty stays."""
    draw = lambda name: uniform(seed, F.lit(name), key)
    ranked = F.array_sort(F.array(*[F.struct(draw(f"op{i}").alias("u"), F.lit(i).alias("op")) for i in range(5)]))
    chosen = F.slice(ranked, F.lit(1), (F.lit(1) + F.floor(draw("many") * 3)).cast("int"))
    where, which = draw("where"), draw("which")

    def step(t, o):
        op = o["op"]
        return (
            F.when(op == 0, drop_subtitle(t)).when(op == 1, swap_first_two_words(t)).when(op == 2, typo(t, where, which))
            .when(op == 3, abbreviate(t)).otherwise(strip_punctuation(t))
        )

    return F.coalesce(F.nullif(F.trim(F.aggregate(chosen, title, step)), F.lit("")), title)


def perturb_price(price: Column, key: Column, seed=0) -> Column:
    shift = uniform(seed, F.lit("shift"), key) * 0.30 - 0.15
    changed = F.round(price.cast("double") * (1 + shift), 2)
    return F.when(uniform(seed, F.lit("price"), key) < 0.6, changed).otherwise(price.cast("double"))


def perturb_category(category: Column, others: list[str], key: Column, seed=0) -> Column:
    """A tenth blank, a tenth one of the catalogue's categories, a list of a size that the caller answers for."""
    roll = uniform(seed, F.lit("category"), key)
    pick = (F.floor(uniform(seed, F.lit("pick"), key) * len(others))).cast("int")
    other = F.get(F.array(*[F.lit(o) for o in others]), pick) if others else F.lit("")
    return F.when(roll < 0.10, "").when(roll < 0.20, other).otherwise(category)


def parts(catalogue: DataFrame, key: str = "upc", seed=0) -> DataFrame:
    """Adds ``part``: shared, left or right, in exact numbers (rounded down) by rank of a seeded hash.

    The hashes at the borders are found by counts, so rows are not sorted and not joined.
    """
    from .model import cut_hashes

    u = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("part"), F.col(key).cast("string")))
    n = catalogue.count()
    shared = int(n * SHARED)
    ranks = {"shared": shared, "left": shared + int(n * LEFT_ONLY)}
    hashed = catalogue.select(F.explode(F.array(*[F.lit(k) for k in ranks])).alias("split"), u.alias("_u"))
    cuts = cut_hashes(hashed, ranks)
    part = F.when(u <= cuts["shared"], "shared").when(u <= cuts["left"], "left").otherwise("right")
    return catalogue.withColumn("part", part)


def make(catalogue: DataFrame, others: list[str], seed=0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Left, right and truth from a catalogue of upc, title, category and price; upc has to be unique."""
    from .entities import dense_numbers
    from .quality import check_unique

    check_unique(catalogue, "upc")
    rows = parts(catalogue, "upc", seed).withColumnRenamed("part", "_part")
    left = rows.where("_part <> 'right'").select(F.col("upc").alias("left_id"), "title", "category", "price")
    key = F.col("upc")
    right = rows.where("_part <> 'left'").select(
        "upc", "_part", perturb_title(F.col("title"), key, seed).alias("title"),
        perturb_category(F.col("category"), others, key, seed).alias("category"), perturb_price(F.col("price"), key, seed).alias("price"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), key.cast("string"))).alias("_order"),
    )
    right = dense_numbers(right, "_order", "_n").withColumn("right_id", F.format_string("R%04d", F.col("_n") - 1))
    truth = right.where("_part = 'shared'").select(F.col("upc").alias("left_id"), "right_id")
    return left, right.select("right_id", "title", "category", "price"), truth
