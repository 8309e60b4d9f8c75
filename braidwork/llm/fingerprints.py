"""Document fingerprints: closed syncmers.

A text is a sequence of tokens: its words, where each character of a script that is written without
blanks is a word of its own; ``PAD`` marks stand before and behind it. One rule holds for texts of all
sizes. Among all runs of ``K`` tokens, those are anchors whose smallest inner run of ``S`` tokens (by
hash) lies at an edge. Whether a run is an anchor depends on its own tokens alone, so an edit moves or
removes only the anchors that it touches. One of any ``K - S`` runs in a row is an anchor, so every text
with a word has one, and the distance from one anchor to the next is a digit from 1 to ``K - S``.

The fingerprint lists all anchors in order, each as that digit and eight hexadecimal digits of its hash.
Likeness matches the anchors of two texts by hash and then by position: a match counts if it keeps the
order of the texts with the match before or behind it. All steps are DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty, words

K, S, PAD = 5, 2, 3
#: Hashes of the marks before and behind a text.
START, END = 0x5EED0001, 0x5EED0002
#: Fixed ranges: Thai to Lao, Myanmar, Khmer, kana, and ideographs, which are written without blanks.
UNSPACED = "[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿]"
#: About so many rows follow each other in one task; so many tasks have borders that the driver knows.
SPAN, MAX_SPANS = 1024, 1 << 14
_LOW = (1 << 31) - 1


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, not once per use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def anchors(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: all anchors in order, each a number: 31 bits of its hash, then 32 bits of its position."""
    marks = lambda h: F.array_repeat(F.lit(h).cast("bigint"), PAD)
    spaced = F.regexp_replace(text_or_empty(text), UNSPACED, " $0 ")
    hashed = F.transform(words(spaced), lambda w: F.xxhash64(w))
    inner = F.transform(
        F.slice("_h", F.lit(1), F.greatest(F.size("_h") - (S - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(F.col("_h"), i + j) for j in range(1, S)]),
    )
    last = K - S
    at = lambda i, j: F.get(F.col("_m"), i + j)
    closed = lambda x, i: F.least(x, at(i, last)) <= F.least(*[at(i, j) for j in range(1, last)])
    code = lambda x, i: F.shiftleft(
        F.xxhash64(x, *[at(i, j) for j in range(1, last + 1)]).bitwiseAND(F.lit(_LOW)), 32
    ).bitwiseOR(i.cast("bigint"))
    found = F.transform(
        F.slice("_m", F.lit(1), F.greatest(F.size("_m") - last, F.lit(0))), lambda x, i: F.when(closed(x, i), code(x, i))
    )
    return (
        docs.withColumn("_w", hashed)
        .withColumn("_h", F.when(F.size("_w") > 0, F.concat(marks(START), F.col("_w"), marks(END))).otherwise(F.col("_w")))
        .withColumn("_m", inner)
        .withColumn(out, F.array_compact(found))
        .drop("_w", "_h", "_m")
    )


def _hash(code: Column) -> Column:
    return F.shiftright(code, 32)


def _place(code: Column) -> Column:
    return code.bitwiseAND(F.lit((1 << 32) - 1))


def as_text(found: Column) -> Column:
    """Nine hexadecimal digits for each anchor; an empty string for a text without words."""
    gap = lambda x, i: _place(x) - F.coalesce(_place(F.get(found, i - 1)), F.lit(-1).cast("bigint"))
    return F.array_join(F.transform(found, lambda x, i: F.lower(F.hex(F.shiftleft(gap(x, i), 32).bitwiseOR(_hash(x))))), "")


def distinct(found: Column) -> Column:
    """Anchors sorted by hash, each hash at its first position."""
    new = lambda a: F.filter(a, lambda x, i: (i == 0) | (_hash(x) != _hash(F.get(a, i - 1))))
    return _bound(F.sort_array(found), new)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from ``distinct`` anchors: matches in order with a neighbour, of all distinct anchors of both.

    Both sides are sorted together, so what matches stands side by side. Two texts without words are
    alike (1); one without words is unlike any other (0).
    """
    second = F.transform(b, lambda x: x.bitwiseOR(F.lit(1 << 31)))
    pair = lambda x, y: F.shiftleft(_place(x), 32).bitwiseOR(y.bitwiseAND(F.lit(_LOW)))
    pairs = lambda m: F.array_compact(
        F.transform(m, lambda x, i: F.when(F.coalesce(_hash(x) == _hash(F.get(m, i + 1)), F.lit(False)), pair(x, F.get(m, i + 1))))
    )
    before = lambda p, q: F.coalesce(_place(p) < _place(q), F.lit(False))
    kept = lambda p: F.size(
        F.filter(p, lambda x, i: (F.size(p) == 1) | before(F.get(p, i - 1), x) | before(x, F.get(p, i + 1)))
    )
    counted = lambda p: F.struct(F.size(p).alias("all"), kept(p).alias("kept"))
    found = _bound(F.sort_array(_bound(F.sort_array(F.concat(a, second)), pairs)), counted)
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(_bound(found, lambda f: f["kept"] / (total - f["all"])))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as text.

    Null and empty texts get an empty one, equal texts equal ones; very long texts have all their anchors;
    repeated rows are alike; an empty table stays empty; a column named ``out`` is replaced.
    """
    return anchors(docs, text, "_anchors").withColumn(out, as_text(F.col("_anchors"))).drop("_anchors")


def _cuts(keys: DataFrame) -> list:
    """Borders that split the keys into runs of about ``SPAN``, from a hashed sample of bounded size."""
    n = keys.count()
    spans = min(MAX_SPANS, n // SPAN + 1)
    every = max(1, n // (16 * spans))
    picked = keys.where(F.pmod(F.xxhash64("_key"), F.lit(every)) == 0).distinct().orderBy("_key").collect()
    step = max(1, len(picked) // spans)
    return [r["_key"] for r in picked[step::step]]


def _span_of(key: Column, cuts: list) -> Column:
    """How many borders are not above the key, by a search of two levels."""
    width = max(1, int(len(cuts) ** 0.5))
    shown = lambda c: f'{{"k":{str(c["k"]).lower()},"a":{c["a"]},"b":{c["b"]}}}'
    kind = "struct<k:boolean,a:bigint,b:bigint>"
    heads = F.from_json(F.lit("[" + ",".join(map(shown, cuts[::width])) + "]"), f"array<{kind}>")
    runs = ",".join("[" + ",".join(map(shown, cuts[i : i + width])) + "]" for i in range(0, len(cuts), width))
    runs = F.from_json(F.lit(f"[{runs}]"), f"array<array<{kind}>>")
    reached = lambda cut: cut <= key
    return _bound(
        F.size(F.filter(heads, reached)),
        lambda i: F.when(i == 0, 0).otherwise((i - 1) * width + F.size(F.filter(F.get(runs, i - 1), reached))),
    )


def with_successor(docs: DataFrame, text: str, derive: Callable[[DataFrame], DataFrame], values: list[str], doc_id: str = "doc_id") -> DataFrame:
    """Adds ``next_<value>`` of the row that follows by descending id; the first row follows the last.

    ``derive`` adds columns to rows; it works on each row once, behind the only shuffle. Rows with equal
    ids follow each other by the hash of their text; rows without an id come last. Rows are dealt into
    runs of about ``SPAN`` by borders in the order of ids and hashes; only rows that are equal in both
    stay together. The first row of each run is also put behind the last one of the run above.
    """
    key = F.struct(
        F.col(doc_id).isNotNull().alias("k"), F.coalesce(F.col(doc_id), F.lit(0)).cast("bigint").alias("a"), F.xxhash64(text).alias("b")
    )
    rows = docs.withColumn("_key", key)
    cuts = _cuts(rows.select("_key"))
    rows = rows.withColumn("_span", _span_of(F.col("_key"), cuts))
    tops = {r["_span"]: r["top"] for r in rows.groupBy("_span").agg(F.max("_key").alias("top")).collect()}  # a row per run
    order = sorted(tops)
    above = {s: order[(i + 1) % len(order)] for i, s in enumerate(order)}
    spark = docs.sparkSession
    kind = "_span int, _above int, _key struct<k:boolean,a:bigint,b:bigint>"
    firsts = F.broadcast(spark.createDataFrame([(s, above[s], tops[s]) for s in order], kind))
    firsts = rows.join(firsts, ["_span", "_key"]).dropDuplicates(["_span"]).withColumn("_span", F.col("_above")).drop("_above")
    both = rows.withColumn("_more", F.lit(False)).unionByName(firsts.withColumn("_more", F.lit(True)))
    made = derive(both.repartition("_span"))
    along = Window.partitionBy("_span").orderBy("_more", F.col("_key").desc())
    found = made.withColumns({f"next_{v}": F.lead(v).over(along) for v in values})
    return found.where(~F.col("_more")).drop("_span", "_key", "_more")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text and its successor by descending ``doc_id``.

    The last third of a text is replaced by as many first characters of its successor. Null texts
    count as empty; a single document is its own successor; an empty table gives an empty result; other
    columns of the table are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    rows = with_successor(docs, "text", lambda df: anchors(df, "text", "found").withColumn("keys", distinct(F.col("found"))), ["text", "keys"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.select("doc_id", "found", "keys", "next_keys", n.cast("bigint").alias("n_chars"), edited.alias("edited"))
    rows = anchors(rows.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_found")
    rows = rows.drop("edited").withColumn("edited_keys", distinct(F.col("edited_found")))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("found")).alias("fingerprint"),
        as_text(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(F.col("keys"), F.col("edited_keys")).alias("near_edited"),
        likeness(F.col("keys"), F.col("next_keys")).alias("near_next"),
    )
