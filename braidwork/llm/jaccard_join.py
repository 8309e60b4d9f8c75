"""N-gram Jaccard join in metric space: pivots, triangle-inequality windows, exact recursion.

Documents are sets of hashed word shingles, and 1 minus their Jaccard similarity is a metric. Equal sets
are one point. A plain choice of pivots can't tell texts apart (almost every distance is 1), so regions
come first from what a link needs: under one order of all shingles, common ones last, two linked sets
share ``k`` of their first ``n - ceil(0.8 n) + k`` shingles. With ``k`` a part of ``n``, most texts that share
a few shingles by chance show by their own count of shared ones that they are linked with nothing, and
leave. The smallest point with such a shingle is a pivot, and the points that share one with it are its region.

1. Every point meets the pivots of its regions, a number in proportion to the points. A bound from bits
   of the sets, one per shingle, rejects most of these meetings, texts decide the others exactly, and each
   point keeps an interval for its distance to each pivot.
2. Points within the radius of a pivot are linked to it, and links make classes. A region whose points are
   all in one class is done. In the others, the class of the pivot is the core and the points outside are
   the boundary; only they can still add a link. They meet the points of the region whose intervals lie
   within the radius of theirs (triangle inequality) and whose sizes allow a link, as do their places: what
   comes before the first shingle that a set has in the region is not shared.
3. Regions with a large boundary take ``PIVOTS`` more pivots and fall into their Voronoi regions and a
   rest that is near none of them, with points replicated to all regions within the window. These go
   through the same steps again, until no region is left with two classes.

Nothing is capped: common shingles come last in the order but still count, and a region ends only when it
has one class or all its remaining meetings have been decided.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import join_hot, map_texts, released, stored, table
from .shingles import identity, parity, shingle_set

#: Links need 100 * intersection >= LINK * union.
LINK = 80
#: A shingle met in more than this many texts comes late in the order; at most so many are set back.
COMMON, MAX_COMMON = 16, 200_000
#: One shingle in so many, and one more, is added to the first ones and has to be shared as well.
EXTRA = 20
#: Regions whose boundary is at most so large decide all their meetings; others take more pivots first.
BOUNDARY, PIVOTS = 64, 8
#: Up to so many texts are picked by a broadcast of their ids; beyond, by a shuffle.
MAX_BROADCAST = 500_000
#: Shingles of sets that a worker remembers between the pairs that it decides.
REMEMBERED = 200_000
#: First shingles that one task groups, and the most such tasks.
TASK_ENTRIES, MAX_TASKS = 100_000, 20_000
#: Bits of a shingle's place among the first ones.
PLACE = 18
#: The pivot of a region without one.
NOBODY = -(1 << 63)
RADIUS = 1 - LINK / 100
#: Distances are floats, so bounds that can be met exactly are compared with this to spare.
TOLERANCE = 1e-9
_TOP = np.uint64(1) << np.uint64(63)


def first_count(n: int) -> int:
    """How many shingles of a set of ``n`` are first ones: ``k = 1 + n // EXTRA`` more than a link can do without."""
    return min(n, n - -(-LINK * n // 100) + 1 + n // EXTRA)


def first_count_of(n: Column) -> Column:
    return F.least(n, n - F.floor((LINK * n + 99) / 100) + 1 + F.floor(n / EXTRA))


def shared_count(n: Column) -> Column:
    """So many first shingles a set of ``n`` shares with each set that it is linked with.

    Of two linked sets each has the first ``k`` shared shingles among its first ones, for the smaller ``k`` of
    the two; and the smaller set has ``ceil(0.8 n)`` shingles at least.
    """
    return F.floor((F.floor((LINK * n + 99) / 100)) / EXTRA) + 1


def ordered(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Keys of a set in the order of all shingles, those in ``common`` last, as unsigned numbers."""
    keys = found >> np.uint64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
        keys = np.where(common[at] == keys, keys | _TOP, keys)
    return np.sort(keys)


def _common(docs: DataFrame) -> np.ndarray:
    """Shingles to set back in the order: those met more than ``COMMON`` times in all texts, by counts that
    leave out what occurs once in a batch of texts. They decide how much work there is, not the result."""

    def repeated(texts: list[str | None]) -> list:
        sets = {identity(s): s for s in map(shingle_set, texts) if len(s)}
        keys = np.concatenate([s >> np.uint64(1) for s in sets.values()] or [np.zeros(0, np.uint64)])
        found, n = np.unique(keys, return_counts=True)
        found, n = found[n > 1].view(np.int64), n[n > 1]
        return [[found, *[None] * (len(texts) - 1)], [n, *[None] * (len(texts) - 1)]]

    rows = map_texts(docs.select("_text"), "_text", repeated, "h array<bigint>, n array<bigint>").where("h is not null")
    rows = rows.select(F.inline(F.arrays_zip("h", "n")))
    counts = rows.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON)
    found = counts.orderBy(F.desc("n"), "h").limit(MAX_COMMON).collect()
    return np.sort(np.array([r["h"] for r in found], dtype=np.int64).view(np.uint64))


def _half(z: Column) -> Column:
    """The bits for half the places, by XOR of both halves."""
    half = (F.size(z) / 2).cast("int")
    return F.zip_with(F.slice(z, F.lit(1), half), F.slice(z, half + 1, F.size(z)), lambda p, q: p.bitwiseXOR(q))


def _differing(x: Column, y: Column) -> Column:
    """In how many bits two sets' parities differ; the longer one, twice as long at most, is folded first."""
    folded = lambda z, w: F.when(F.size(z) > F.size(w), _half(z)).otherwise(z)
    counts = F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(counts, F.lit(0), lambda total, n: total + n)


def _bound(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (a, b) with ``low``, a bound of their distance from below: what differs in parity differs.

    Sizes of a pair have to allow a link.
    """
    x = points.select(F.col("v").alias("a"), F.col("bits").alias("_x"), F.col("n").alias("_n"))
    y = points.select(F.col("v").alias("b"), F.col("bits").alias("_y"), F.col("n").alias("_m"))
    differ = _differing(F.col("_x"), F.col("_y"))
    rows = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "_n", "_m", differ.alias("_d"))
    return rows.select("a", "b", (2 * F.col("_d") / (F.col("_n") + F.col("_m") + F.col("_d"))).alias("low"))


def _decide(pairs: DataFrame, docs: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) with ``distance``, exact, and ``link``, worked out from whole texts; and a table they read."""
    needed = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "v")
    needed = stored(points.join(needed, "v", "left_semi").select("v", F.col("row").alias("_row")), "needed")
    small = needed.count() <= MAX_BROADCAST
    texts = docs.join(F.broadcast(needed) if small else needed, "_row").select("v", F.col("_text").alias("t"))
    rows = pairs.select("a", "b").join(texts.select(F.col("v").alias("a"), F.col("t").alias("s")), "a").join(
        texts.select(F.col("v").alias("b"), "t"), "b"
    )

    def decided(batches):
        sets: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(v: int, text) -> np.ndarray:
            if v not in sets:
                sets[v] = shingle_set(text.as_py())
                while len(sets) > 2 and sum(map(len, sets.values())) > REMEMBERED:
                    sets.popitem(last=False)
            return sets[v]

        for t in batches:
            a, b, s, u = (t.column(c) for c in ("a", "b", "s", "t"))
            distance, link = [], []
            for i in range(t.num_rows):
                x, y = of(a[i].as_py(), s[i]), of(b[i].as_py(), u[i])
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                distance.append(1 - both / either)
                link.append(100 * both >= LINK * either)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b, "distance": distance, "link": link})

    schema = "a bigint, b bigint, distance double, link boolean"
    return rows.select("a", "b", "s", "t").mapInArrow(decided, schema), needed


def _sizes_allow(n, m):
    return 100 * F.least(n, m) >= LINK * F.greatest(n, m)


def _shared_allow(shared, n):
    """Two sets whose sizes add up to ``n`` can link if they share at most ``shared`` shingles."""
    return (100 + LINK) * shared >= LINK * n


def _meet(pairs: DataFrame, docs: DataFrame, points: DataFrame) -> DataFrame:
    """For distinct pairs (a, b): ``low`` and ``high`` bounds of the distance, and ``link``; stored."""
    # Pairs are mostly few; as a table their size is known, so they go to the points and not the other way.
    pairs = stored(pairs.select("a", "b"), "pairs")
    bounded = stored(_bound(pairs, points), "bounds")
    close = bounded.where(F.col("low") <= RADIUS + TOLERANCE)
    exact, needed = _decide(close, docs, points)
    rows = exact.select("a", "b", F.col("distance").alias("low"), F.col("distance").alias("high"), "link").union(
        bounded.where(F.col("low") > RADIUS + TOLERANCE).select("a", "b", "low", F.lit(1.0).alias("high"), F.lit(False).alias("link"))
    )
    met = stored(rows, "meetings")
    released(pairs, bounded, needed)
    return met


def _regions(begins: DataFrame) -> DataFrame:
    """(pivot, v, pos) of entries (e, v) whose shingle is met in two points or more; the pivot is the smallest.

    Entries of a shingle stand together, sorted by point, and are read as a stream: however many there are,
    only the first one is held.
    """

    def found(batches):
        last, pivot, held = None, 0, None
        for t in batches:
            e, v = (t.column(c).to_numpy(zero_copy_only=False) for c in ("e", "v"))
            h, pos, n = e >> PLACE, e & ((1 << PLACE) - 1), len(e)
            if not n:
                continue
            start = np.concatenate([[last is None or h[0] != last], h[1:] != h[:-1]])
            at = np.maximum.accumulate(np.where(start, np.arange(n), -1))
            pivots = np.where(at < 0, pivot, v[np.maximum(at, 0)])
            keep = ~start
            keep[:-1] |= ~start[1:]
            out = [(pivots[keep], v[keep], pos[keep])]
            if held is not None and not start[0]:
                out.insert(0, held)
            last, pivot = h[-1], int(pivots[-1])
            held = (np.array([pivot]), v[-1:], pos[-1:]) if start[-1] else None
            made = [np.concatenate([o[i] for o in out]) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.int32())], names=["pivot", "v", "pos"])

    return begins.select("e", "v").mapInArrow(found, "pivot bigint, v bigint, pos int")


def link_classes(docs: DataFrame) -> DataFrame:
    """For ``docs`` with _row (unique, not null) and _text: the rows that have shingles, with ``n`` and ``class``."""
    spark = docs.sparkSession
    common = _common(docs)

    def measured(texts: list[str | None]) -> list:
        sets = [shingle_set(t) for t in texts]
        return [[len(s) for s in sets], [identity(s) for s in sets], [parity(s) for s in sets]]

    def begun(texts: list[str | None]) -> list:
        sets = [shingle_set(t) for t in texts]
        return [[ordered(s, common)[: first_count(len(s))].view(np.int64) for s in sets]]

    made = map_texts(docs.select("_row", "_text"), "_text", measured, "n bigint, code bigint, bits array<bigint>")
    rows = stored(made.where("n > 0"), "sets")
    codes = stored(rows.groupBy("code").agg(F.min("_row").alias("v"), F.count("*").alias("k")), "codes")
    # Copies are found by codes and rows alone; sets are left where they lie.
    copies = join_hot(rows.select("_row", "code"), codes.where("k > 1"), "code", "k", rows.count(), ["_row"])
    copies = stored(copies.where("v <> _row").select("_row"), "copies")
    few = copies.count() <= MAX_BROADCAST
    points = rows.join(F.broadcast(copies) if few else copies, "_row", "left_anti").select(F.col("_row").alias("v"), "n", "bits")
    points = (points if few else stored(points, "points")).withColumn("row", F.col("v"))
    # First shingles are worked out from the texts as they are dealt: written, they would take half the input's place.
    firsts = map_texts(docs.select("_row", "_text"), "_text", begun, "first array<bigint>").where(F.size("first") > 0)
    firsts = firsts.join(F.broadcast(copies) if few else copies, "_row", "left_anti").select(F.col("_row").alias("v"), "first")
    # They are mostly met once: they are dealt by shingle right away, into tasks of a fixed size.
    entries = points.agg(F.coalesce(F.sum(first_count_of(F.col("n"))), F.lit(0))).first()[0]
    tasks = min(MAX_TASKS, max(spark.sparkContext.defaultParallelism, entries // TASK_ENTRIES + 1))
    # An entry is two numbers: 46 bits of the shingle over 18 of its place, and the point. Shingles that agree
    # in 46 bits make a region too many, places beyond 18 bits a bound too weak; neither loses a link.
    place = F.least(F.col("pos"), F.lit((1 << PLACE) - 1)).cast("bigint")
    entry = F.shiftleft(F.col("h"), PLACE).bitwiseOR(place).alias("e")
    shingle = F.shiftrightunsigned("e", PLACE)
    begins = firsts.select("v", F.posexplode("first").alias("pos", "h")).select(entry, "v")
    begins = begins.repartition(tasks, shingle).sortWithinPartitions(shingle, "v")
    # Regions with one pivot are one region: copies share many shingles, and so many regions.
    # Two linked sets are both in the region of the first shingle that they share, and ``pos`` isn't beyond it.
    found = stored(_regions(begins).groupBy("pivot", "v").agg(F.min("pos").alias("pos"), F.count("*").alias("shared")), "found")
    # Points that share too few to be linked with any other leave; the smallest that stays is the pivot.
    shares = stored(found.groupBy("v").agg(F.sum("shared").alias("shared")), "shares")
    alive = shares.join(points.select("v", "n"), "v").where(F.col("shared") >= shared_count(F.col("n"))).select("v")
    alive = stored(alive, "alive")
    few = alive.count() <= MAX_BROADCAST
    points = stored(points.join(F.broadcast(alive) if few else alive, "v", "left_semi").select("v", "n", "bits", "row"), "points")
    stay = stored(found.drop("shared").withColumnRenamed("pivot", "r").join(points.select("v", "n"), "v"), "stay")
    pivots = stay.groupBy("r").agg(F.min("v").alias("pivot"), F.count("*").alias("k")).where("k > 1").select("r", "pivot")
    # Regions that come to the same pivot are one again.
    merged = stay.join(pivots, "r").groupBy("pivot", "v").agg(F.min("pos").alias("pos"), F.first("n").alias("n"))
    merged = stored(merged.withColumn("r", F.col("pivot")), "regions")
    released(found, shares, alive, stay)
    links = spark.createDataFrame([], "a bigint, b bigint")
    of, closed = None, False

    def add(met: DataFrame) -> None:
        """Keeps the links between different classes; where there is one, classes are worked out anew."""
        nonlocal links, closed
        new = met.where("link").select("a", "b")
        if of is not None:
            x, y = (of.select(F.col("v").alias(c), F.col("class").alias(f"_{c}")) for c in ("a", "b"))
            new = new.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
        new = stored(new, "links")
        if new.head(1):
            links, closed = links.union(new), False

    def close() -> None:
        nonlocal of, closed
        if not closed:
            found = components(links, "a", "b").select(F.col("vertex").alias("v"), F.col("component").alias("class"))
            of, closed = stored(found, "classes"), True

    def meet_pivots(todo: DataFrame) -> DataFrame:
        """``todo`` (r, parent, v, n, pos, pivot) with the interval of each distance; links are kept."""
        todo = todo.join(points.select(F.col("v").alias("pivot"), F.col("n").alias("m")), "pivot")
        pairs = todo.where(_sizes_allow(F.col("n"), F.col("m"))).where("v <> pivot").select("v", "pivot").distinct()
        met = _meet(pairs.select(F.col("v").alias("a"), F.col("pivot").alias("b")), docs, points)
        add(met)
        known = met.select(F.col("a").alias("v"), F.col("b").alias("pivot"), "low", "high")
        # Pairs that sizes rule out have not met: they are further apart than the radius, and than sizes tell.
        own = F.col("v") == F.col("pivot")
        apart = F.greatest(F.lit(RADIUS), 1 - F.least("n", "m") / F.greatest("n", "m"))
        found = stored(
            todo.join(known, ["v", "pivot"], "left")
            .withColumn("low", F.when(own, 0.0).otherwise(F.coalesce("low", apart)))
            .withColumn("high", F.when(own, 0.0).otherwise(F.coalesce("high", F.lit(1.0)))).drop("m"),
            "met",
        )
        released(met)
        return found

    todo = meet_pivots(merged.withColumn("parent", F.lit(1 << 62)))
    while True:
        close()
        heads = of.select(F.col("v").alias("pivot"), F.col("class").alias("head"))
        inside = todo.join(of, "v", "left").join(heads, "pivot", "left").withColumn("class", F.coalesce("class", "v"))
        inside = inside.withColumn("core", F.col("class") == F.coalesce("head", "pivot")).drop("head")  # NOBODY is no class
        counts = inside.groupBy("r").agg(
            F.min("class").alias("c"), F.max("class").alias("d"), F.sum((~F.col("core")).cast("bigint")).alias("boundary"),
            F.count("*").alias("size"), F.max("parent").alias("was"), F.count_if(F.col("v") != F.col("pivot")).alias("unmet"),
        ).where("c <> d AND unmet > 1")
        # A region that didn't shrink to half of the one it comes from gains nothing from more pivots.
        last = (F.col("boundary") <= BOUNDARY) | (2 * F.col("size") > F.col("was"))
        counts = stored(counts.select("r", "size", last.alias("last")), "open")
        rest = inside.where("v <> pivot")  # pivots have met all points of their region
        # Those that are left are few; bits for half the places come along, so that a pair is only made if they
        # allow it: enough for unlike texts. Pairs that are made meet with all their bits.
        here = rest.join(counts.where("last").select("r"), "r", "left_semi")
        here = stored(here.select("r", "v", "n", "pos", "class", "core", "low", "high"), "here")
        bits = points.join(here.select("v").distinct(), "v", "left_semi")
        bits = bits.select("v", F.when(F.size("bits") > 1, _half(F.col("bits"))).otherwise(F.col("bits")).alias("bits"))
        here_bits = here.join(bits, "v")
        edge = here_bits.where("not core").select("r", *[F.col(c).alias(f"{c}_a") for c in ("v", "n", "pos", "class", "low", "high", "bits")])
        window = RADIUS + TOLERANCE
        near = (F.col("low_a") <= F.col("high") + window) & (F.col("low") <= F.col("high_a") + window)
        other = (F.col("class_a") != F.col("class")) & (F.col("core") | (F.col("v_a") < F.col("v")))
        shared = F.least(F.col("n") - F.col("pos"), F.col("n_a") - F.col("pos_a"))
        both_n = F.col("n") + F.col("n_a")
        allowed = _sizes_allow(F.col("n"), F.col("n_a")) & _shared_allow(shared, both_n)
        # What differs in parity differs, and of n + m entries two linked sets differ in a ninth at most.
        alike = (100 + LINK) * _differing(F.col("bits"), F.col("bits_a")) <= (100 - LINK) * both_n
        pairs = here_bits.join(edge, "r").where(near & other & allowed & alike)
        more = _meet(pairs.select(F.col("v_a").alias("a"), F.col("v").alias("b")).distinct(), docs, points)
        add(more)
        released(more)
        released(here)
        large = counts.where("not last").select("r", "size")
        if not large.head(1):
            break
        # Pivots of the next regions are half the points nearest to the old pivot, for what many copies were
        # made from is near each of them, and half boundary points.
        left = rest.join(large, "r")
        near_first = Window.partitionBy("r").orderBy("low", "high", "v")
        outside = Window.partitionBy("r").orderBy(F.col("core"), F.xxhash64("v"), "v")
        half = PIVOTS // 2
        picked = left.withColumn("_k", F.row_number().over(near_first)).where(F.col("_k") <= half).select("r", F.col("v").alias("pivot"))
        others = left.withColumn("_k", F.row_number().over(outside)).where(F.col("_k") <= half).select("r", F.col("v").alias("pivot"))
        picked = stored(picked.union(others).distinct(), "pivots")
        cells = left.select("r", F.col("size").alias("parent"), "v", "n", "pos").join(picked, "r")
        cells = met = meet_pivots(cells)
        # Two linked points, one of them within the radius of a pivot, are both within twice the radius of it;
        # two that are beyond the radius of all pivots are both in the rest, a region without a pivot.
        near_cells = cells.where(F.col("low") <= 2 * RADIUS + TOLERANCE).withColumn("r", F.xxhash64("r", "pivot"))
        far = cells.groupBy("r", "v").agg(
            F.min("high").alias("low"), F.first("parent").alias("parent"), F.first("n").alias("n"), F.first("pos").alias("pos")
        ).where(F.col("low") > RADIUS + TOLERANCE)
        far = far.select("v", F.lit(NOBODY).cast("bigint").alias("pivot"), F.xxhash64("r", F.lit("rest")).alias("r"), "parent", "n", "pos", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
        old, todo = todo, stored(near_cells.select(*far.columns).unionByName(far), "cells")
        released(old, met, picked)
    close()
    classes = stored(codes.join(of, "v", "left").select("code", F.coalesce("class", "v").alias("class"), "k"), "classes")
    return join_hot(rows.select("_row", "n", "code"), classes, "code", "k", rows.count(), ["_row"]).select("_row", "n", "class")


def _numbered(docs: DataFrame, doc_id: str) -> DataFrame:
    """Adds ``_row``: the id where ids are unique and not null, else numbers fixed by writing them."""
    ids = docs.agg(F.count("*").alias("n"), F.countDistinct(doc_id).alias("d")).first()
    if ids["n"] == ids["d"]:
        return docs.withColumn("_row", F.col(doc_id).cast("bigint"))
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``.

    ``component_id`` is the smallest ``doc_id`` reachable by links, its own included. Null and empty texts
    have no shingles and reach nothing else; texts of fewer than five words are one shingle; repeated rows
    and rows without an id are rows of their own (a component without any id has none); an empty table
    gives an empty result; other columns are not read.
    """
    rows = _numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "doc_id")
    found = link_classes(rows.select("_row", "_text"))
    out = stored(rows.select("_row", "doc_id").join(found, "_row", "left").select("doc_id", "n", "class"), "joined")
    smallest = out.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("k"))
    return join_hot(out, stored(smallest, "smallest"), "class", "k", out.count(), ["doc_id", "n"]).select(
        "doc_id",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"),
    )


def one_per_class(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class, the one with the smallest id stays.

    Texts without words stay all. Of rows with equal ids the first written stays.
    """
    rows = _numbered(docs, doc_id)
    found = link_classes(rows.select("_row", F.col(text).alias("_text")))
    joined = stored(rows.select("_row", F.col(doc_id).alias("_id")).join(found, "_row").select("_row", "_id", "class"), "joined")
    order = F.struct(F.col("_id").isNull().alias("a"), F.col("_id").alias("b"), F.col("_row").alias("c"))
    first = joined.groupBy("class").agg(F.min(order)["c"].alias("_first"), F.count("*").alias("k")).where("k > 1")
    first = join_hot(joined, stored(first, "firsts"), "class", "k", joined.count(), ["_row"])
    gone = stored(first.where("_row <> _first").select("_row"), "gone")
    small = gone.count() <= MAX_BROADCAST
    return rows.join(F.broadcast(gone) if small else gone, "_row", "left_anti").select(*docs.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
),
reach AS (
  SELECT doc_id AS v, doc_id AS r FROM n
  UNION
  SELECT reach.v, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(reach.r) AS component_id FROM n JOIN reach ON reach.v = n.doc_id GROUP BY ALL
"""
