"""Candidate generation: exact keys and nearest neighbours by character n-grams."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import stored

SIZES = (2, 3, 4)
#: The kernel keeps a block of left keys in memory: so many keys and so many of their weights at most.
BLOCK, ENTRIES = 100_000, 10_000_000
#: Cells of a matrix that the kernel makes at once, and of a table of grams by their characters' numbers.
CELLS, TABLE = 4_000_000, 8_000_000
#: Rows of shared grams up to which plain joins are taken.
JOINED = 200_000_000
#: Products of a matrix that take as long as adding one weight.
DENSE = 100
#: Keys that share a gram from which on its weights are added by themselves.
LONG = 256


class Refused(ValueError):
    """Raised where going on would give wrong results."""


def exact_key_pairs(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    return right.select("right_id", key).join(left.select("left_id", key), key).select("left_id", "right_id").distinct()


def grams(key: Column | str) -> Column:
    """Character n-grams of each word padded with a blank at both ends; a short word's padded form counts once."""
    key = F.col(key) if isinstance(key, str) else key
    words = F.filter(F.split(F.coalesce(key, F.lit("")), r"\s+"), lambda w: w != "")

    def runs(padded, n: int):
        starts = F.sequence(F.lit(1), F.length(padded) - (n - 1))
        return F.when(F.length(padded) >= n, F.transform(starts, lambda i: F.substring(padded, i, F.lit(n))))

    def of(word):
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return F.concat(*[F.coalesce(runs(padded, n), F.array().cast("array<string>")) for n in SIZES])

    return F.flatten(F.transform(words, of))


def weights(left: DataFrame, right: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(id, gram, weight) of both sides: counts times idf of the left side, scaled to unit length.

    Grams that the left side lacks are dropped before scaling.
    """
    counted = lambda df, i: df.select(i, F.explode(grams(key)).alias("gram")).groupBy(i, "gram").agg(F.count("*").alias("tf"))
    a, b = counted(left, "left_id"), counted(right, "right_id")
    n = left.agg(F.count("*").alias("n"))
    idf = a.groupBy("gram").agg(F.count("*").alias("df")).join(F.broadcast(n))
    idf = idf.select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))

    def scaled(df: DataFrame, i: str) -> DataFrame:
        raw = df.join(idf, "gram").withColumn("w", F.col("tf") * F.col("idf"))
        norm = raw.groupBy(i).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return raw.join(norm, i).select(i, "gram", (F.col("w") / F.col("norm")).alias("weight"))

    return scaled(a, "left_id"), scaled(b, "right_id")


def _ranked(df: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("right_id").orderBy(F.round("cosine", 9).desc(), "left_id")
    return df.withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= k)


def nearest_native(left: DataFrame, right: DataFrame, k: int, key: str = "key") -> DataFrame:
    """The plan in plain joins: the model that the kernel is held against, and the one for sparse overlap."""
    a, b = weights(left, right, key)
    score = b.withColumnRenamed("weight", "w").join(a, "gram").groupBy("right_id", "left_id")
    found = _ranked(score.agg(F.sum(F.col("w") * F.col("weight")).alias("cosine")), k)
    # Rights with fewer than k overlapping lefts get the smallest other ids at 0: the k smallest ids hold
    # enough of them, next to those found.
    few = right.select("right_id").join(found.groupBy("right_id").agg(F.count("*").alias("n")), "right_id", "left")
    few = few.where(F.coalesce("n", F.lit(0)) < k).select("right_id")
    smallest = F.broadcast(left.select("left_id").orderBy("left_id").limit(2 * k))
    pad = few.join(smallest).join(found.select("right_id", "left_id"), ["right_id", "left_id"], "left_anti")
    rows = found.select("right_id", "left_id", "cosine").unionByName(pad.withColumn("cosine", F.lit(0.0)))
    return _ranked(rows, k).select("left_id", "right_id", "cosine", "seq")


class _Grams:
    """Finds the grams of texts by their characters' numbers, for all texts of a batch at once.

    Runs of characters that cross words are no grams of any word, so looking them up finds nothing.
    """

    def __init__(self, names: list[str]):
        letters = sorted({c for g in names for c in g} - {" "})
        self.base = len(letters) + 2  # 0 is any other character, 1 a blank
        self.numbers = np.zeros(max(map(ord, letters), default=32) + 2, np.uint64)
        for blank in " \t\n\x0b\f\r":
            self.numbers[ord(blank) : ord(blank) + 1] = 1
        for i, c in enumerate(letters):
            self.numbers[ord(c)] = i + 2
        self.known = {g: i for i, g in enumerate(names)} if self.base > 65_535 else None  # numbers of 4 would not fit
        self.tables = {}
        if self.known is None:
            for n in SIZES:
                of_size = np.array([i for i, g in enumerate(names) if len(g) == n], np.int64)
                codes = self._codes(self._characters("".join(names[i] for i in of_size)), n)[::n] if len(of_size) else np.zeros(0, np.uint64)
                order = np.argsort(codes)
                codes, of_size = codes[order], of_size[order]
                if self.base**n <= TABLE:
                    direct = np.full(self.base**n, -1, np.int32)
                    direct[codes.astype(np.int64)] = of_size
                    self.tables[n] = (None, direct)
                else:
                    self.tables[n] = (codes, of_size)

    def _characters(self, text: str) -> np.ndarray:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.numbers[np.minimum(c, len(self.numbers) - 1)]

    def _codes(self, c: np.ndarray, n: int) -> np.ndarray:
        m = max(len(c) - n + 1, 0)
        out = c[:m].copy()
        for i in range(1, n):
            out *= np.uint64(self.base)
            out += c[i : i + m]
        return out

    def _found(self, c: np.ndarray, n: int) -> np.ndarray:
        codes, numbers = self.tables[n]
        wanted = self._codes(c, n)
        if codes is None:
            return numbers[wanted.astype(np.int64)]
        if not len(codes):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        return np.where(codes[at] == wanted, numbers[at], -1)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, number of the gram) of every gram in the texts."""
        padded = [f" {t or ''} " for t in texts]
        row = np.repeat(np.arange(len(padded)), [len(t) for t in padded])
        rows, grams = [], []
        if self.known is not None:
            for r, t in enumerate(padded):
                met = [self.known[g] for w in re.split(r"[ \t\n\x0b\f\r]+", t) for g in _grams_of(w) if g in self.known]
                rows.append(np.full(len(met), r))
                grams.append(np.array(met, np.int64))
        else:
            c = self._characters("".join(padded))
            for n in SIZES:
                found = self._found(c, n)
                at = np.flatnonzero(found >= 0)
                rows.append(row[at])
                grams.append(found[at].astype(np.int64))
        return np.concatenate(rows), np.concatenate(grams)


def _grams_of(word: str) -> list[str]:
    padded = f" {word} " if word else ""
    return [padded[i : i + n] for n in SIZES for i in range(len(padded) - n + 1)]


def _merged_grams(gram: np.ndarray, at: np.ndarray, tf: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(group of each gram, a gram of each group): grams that the same keys have equally often are one group.

    ``gram``, ``at`` and ``tf`` are sorted by gram and key. Grams that no key has get the group -1.
    """
    group = np.full(size, -1)
    present, first, many = np.unique(gram, return_index=True, return_counts=True)
    if not len(present):
        return group, present
    rng = np.random.default_rng(0)
    marks = rng.integers(1, 2**63, (2, int(at.max()) + 1), dtype=np.uint64)
    sums = [np.add.reduceat(m[at] * (tf.astype(np.uint64) * np.uint64(2) + np.uint64(1)), first) for m in marks]
    _, sample, number = np.unique(np.stack([*sums, many.astype(np.uint64)]), axis=1, return_index=True, return_inverse=True)
    number = number.reshape(-1)
    # Equal sums are held against the lists themselves; what differs stays by itself.
    inside = np.arange(len(gram)) - np.repeat(first, many)
    other = np.repeat(first[sample[number]], many) + inside
    same = np.logical_and.reduceat((at[other] == at) & (tf[other] == tf), first)
    number = np.where(same, number, len(sample) + np.arange(len(present)))
    _, sample, number = np.unique(number, return_index=True, return_inverse=True)
    group[present] = number
    return group, present[sample]


def _packed(keys: list[str], ids: list[list], names: list[str], idf: np.ndarray, id_type: pa.DataType) -> dict:
    """A block of left keys, in the order of their smallest ids, as the kernel takes it."""
    order = sorted(range(len(keys)), key=lambda i: ids[i][0])
    keys, ids = [keys[i] for i in order], [ids[i] for i in order]
    find, parts = _Grams(names), []
    for start in range(0, len(keys), 4096):
        row, gram = find.of(keys[start : start + 4096])
        pair, tf = np.unique(gram * 4096 + row, return_counts=True)
        parts.append((pair // 4096, pair % 4096 + start, tf))
    gram, at, tf = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((at, gram))
    gram, at, tf = gram[order], at[order], tf[order]
    norm = np.sqrt(np.bincount(at, (tf * idf[gram]) ** 2, minlength=len(keys)))
    group, sample = _merged_grams(gram, at, tf, len(names))
    mine = sample[group[gram]] == gram if len(gram) else np.zeros(0, bool)
    part, at, tf = group[gram[mine]], at[mine], tf[mine]
    order = np.lexsort((part, at))
    flat = [i for some in ids for i in some]
    rank = np.empty(len(flat), np.int64)
    rank[sorted(range(len(flat)), key=flat.__getitem__)] = np.arange(len(flat))
    return {
        "names": names, "idf": idf, "group": group, "groups": len(sample), "keys": len(keys),
        "starts": np.searchsorted(at[order], np.arange(len(keys) + 1)), "part": part[order].astype(np.int32),
        "weight": tf[order] / norm[at[order]], "ids": pa.array(flat, id_type), "rank": rank,
        "slots": np.append(0, np.cumsum([len(some) for some in ids])),
    }


def _flat(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``which``, place in what ``starts`` cuts) of all entries of the chosen runs."""
    sizes = starts[which + 1] - starts[which]
    owner = np.repeat(np.arange(len(which)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[which], sizes)


def _kernel(block: dict, k: int, right_type: pa.DataType):
    """For batches of (right_id, key): the k best of one block of left records.

    The scores of some right records with all keys are a product of two matrices in single precision, or, where
    few keys share a gram, sums of the weights that meet. They only tell which keys can be among the best; the cosines of
    those are then worked out in double precision.
    """
    idf, group, groups, keys = (block[c] for c in ("idf", "group", "groups", "keys"))
    starts, part, weight, rank, slots = (block[c] for c in ("starts", "part", "weight", "rank", "slots"))
    find, size = _Grams(block["names"]), len(idf)
    owner = np.repeat(np.arange(keys), np.diff(starts))
    by_part = np.lexsort((owner, part))
    runs, run_at, run_weight = np.searchsorted(part[by_part], np.arange(groups + 1)), owner[by_part], weight[by_part]
    # What a key of this block would meet, if the right side is like the left one.
    dense = groups * keys <= DENSE * (np.diff(runs).astype(float) ** 2).sum() / max(keys, 1)
    width = max(k, 32, min(keys, CELLS // max(groups, 1))) if dense else max(keys, 1)
    cuts = [(i, min(i + width, keys)) for i in range(0, keys, width)]
    error = 2 * (groups + 8) * 2.0**-24 + 2e-9 if dense else 2e-9
    made: dict[int, np.ndarray] = {}

    def matrix(low: int, high: int) -> np.ndarray:
        found = made.get(low)
        if found is None:
            found = np.zeros((groups, high - low), np.float32)
            run = slice(starts[low], starts[high])
            found[part[run], owner[run] - low] = weight[run]
            if groups * keys <= 4 * CELLS:
                made[low] = found
        return found

    def sums(v: np.ndarray) -> np.ndarray:
        """Many short runs of weights are added in one go, each long one by itself."""
        met = np.flatnonzero(v)
        long = runs[met + 1] - runs[met] >= LONG
        of, places = _flat(runs, met[~long])
        total = np.bincount(run_at[places], v[met[~long]][of] * run_weight[places], minlength=keys).astype(np.float64)
        for g in met[long]:
            run = slice(runs[g], runs[g + 1])
            total[run_at[run]] += v[g] * run_weight[run]
        return total

    def kth(total: np.ndarray) -> np.ndarray:
        """At most the k-th best value of each row: that of the best in each of many parts of it."""
        n = total.shape[1]
        if n < k:
            return np.zeros(len(total))
        if n >= 64 * k:
            total = total[:, : n // 32 * 32].reshape(len(total), 32, n // 32).max(1)
            n = total.shape[1]
        return np.partition(total, n - k, axis=1)[:, n - k].astype(np.float64)

    def best(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the text, place of the left id, cosine) of the k best of each text."""
        row, gram = find.of(texts)
        tf = np.bincount(row * size + gram, minlength=len(texts) * size).reshape(len(texts), size)
        norm = np.sqrt((tf.astype(np.float64) ** 2) @ (idf * idf))
        here = group[gram] >= 0
        v = np.bincount(row[here] * groups + group[gram[here]], (idf * idf)[gram[here]], minlength=len(texts) * groups)
        v = v.astype(np.float64).reshape(len(texts), groups) / np.where(norm > 0, norm, 1.0)[:, None]
        least, found = np.zeros(len(texts)), []
        single = v.astype(np.float32) if dense else None
        for low, high in cuts:
            total = single @ matrix(low, high) if dense else np.stack([sums(x) for x in v])
            least = np.maximum(least, kth(total))
            near = (total > 0) & (total >= (least - error)[:, None])
            if low == 0:  # equals at 0 go to the smallest ids
                near[least <= error, :k] = True
            r, j = np.nonzero(near)
            found.append((r, j + low, total[r, j]))
        r, j, total = (np.concatenate(c) for c in zip(*found))
        keep = (total >= least[r] - error) | (least[r] <= error)
        r, j = r[keep], j[keep]
        cosine = np.zeros(len(r))
        step = max(1, CELLS // max(1, int(np.diff(starts).max())))
        for i in range(0, len(r), step):
            some = slice(i, i + step)
            of, places = _flat(starts, j[some])
            cosine[some] = np.bincount(of, v[r[some][of], part[places]] * weight[places], minlength=len(r[some]))
        first = lambda r, *by: (o := np.lexsort((*by, r)))[np.arange(len(o)) - np.searchsorted(r[o], r[o]) < k]
        # A record beyond the k first keys has k others before it, the first of each.
        top = first(r, j, -np.round(cosine, 9))
        of, place = _flat(slots, j[top])
        r, cosine = r[top][of], cosine[top][of]
        top = first(r, rank[place], -np.round(cosine, 9))
        return r[top], place[top], cosine[top]

    def nearest(batches):
        for b in batches:
            lengths = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)))
            i, rows = 0, max(1, min(128, CELLS // max(size, width)))
            while i < b.num_rows:
                # Texts are taken together up to a million bytes, a longer one by itself.
                n = max(1, min(rows, int(np.searchsorted(lengths, lengths[i] + 1_000_000, "right")) - 1 - i))
                some = b.slice(i, min(n, b.num_rows - i))
                i += some.num_rows
                row, place, cosine = best(some.column(1).to_pylist())
                rights = some.column(0).take(pa.array(row)).cast(right_type)
                yield pa.RecordBatch.from_arrays(
                    [block["ids"].take(pa.array(place)), rights, pa.array(cosine)], names=["left_id", "right_id", "cosine"]
                )

    return nearest


def _started(block, k: int, right_type: pa.DataType):
    """The kernel is made in the worker, so that only the block travels."""

    def run(batches):
        yield from _kernel(block, k, right_type)(batches)

    return run


def nearest_neighbours(left: DataFrame, right: DataFrame, k: int, key: str = "key") -> DataFrame:
    """For each right record the ``min(k, lefts)`` nearest left ones: left_id, right_id, cosine, seq.

    Ties go to the smaller left_id; a right record without a known gram has cosine 0 to all. Left records of
    one key are one: it stands for the k smallest of their ids. The keys are cut into blocks of bounded numbers of
    keys and of weights; every block gives its k best to each right record, and the best of those remain. Right
    records are read where they lie, once per block, and only the pairs found are moved.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if k < 1:
        raise Refused("k has to be 1 or more")
    keyed = left.select("left_id", F.coalesce(F.col(key), F.lit("")).alias("_key"))
    order = F.row_number().over(Window.partitionBy("_key").orderBy("left_id"))
    firsts = keyed.withColumn("_n", order).where(F.col("_n") <= k).groupBy("_key").agg(F.sort_array(F.collect_list("left_id")).alias("_ids"))
    firsts = stored(firsts, "keys")
    sizes = keyed.groupBy("_key").agg(F.count("*").alias("_n"))
    counted = stored(sizes.select("_n", F.explode(F.array_distinct(grams("_key"))).alias("gram")).groupBy("gram").agg(F.sum("_n").alias("df"), F.count("*").alias("keys")), "grams")
    n, keys, entries = left.count(), firsts.count(), counted.agg(F.sum("keys")).first()[0] or 0
    table = counted.select("gram", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")).orderBy("gram").toArrow()
    # The right side is weighted by all grams of the left side, whatever block it meets.
    names, idf = table.column("gram").to_pylist(), table.column("idf").to_numpy().astype(np.float64)
    kinds = [to_arrow_type(df.schema[c].dataType) for df, c in ((left, "left_id"), (right, "right_id"))]
    schema = f"left_id {dict(left.dtypes)['left_id']}, right_id {dict(right.dtypes)['right_id']}, cosine double"
    blocks = max(1, -(-keys // BLOCK), -(-entries // ENTRIES))
    block = F.pmod(F.xxhash64("_key"), F.lit(blocks))
    best = None
    for i in range(blocks):
        rows = firsts.where(block == i).select("_key", "_ids").toArrow()
        if not rows.num_rows and blocks > 1:
            continue
        packed = _packed(rows.column("_key").to_pylist(), rows.column("_ids").to_pylist(), names, idf, kinds[0])
        found = right.select("right_id", key).mapInArrow(_started(packed, k, kinds[1]), schema)
        best = found if best is None else best.unionByName(found)
    return _ranked(best, k)


def nearest_joined(left: DataFrame, right: DataFrame, k: int, key: str = "key") -> DataFrame:
    """``nearest_native`` where its join makes at most ``JOINED`` rows, ``nearest_neighbours`` beyond: equal results.

    The join makes a row for each gram that a right record shares with a left one: of texts that share most grams, nearly
    all pairs many times over. Their number is that of right records like the left ones.
    """
    met = left.select("left_id", F.explode(F.array_distinct(grams(key))).alias("gram")).groupBy("gram").agg(F.count("*").cast("double").alias("df"))
    squares = met.agg(F.sum(F.col("df") * F.col("df"))).first()[0] or 0.0
    rows = squares / max(left.count(), 1) * right.count()
    return (nearest_native if rows <= JOINED else nearest_neighbours)(left, right, k, key)


def union_pairs(*pairs: DataFrame) -> DataFrame:
    out = pairs[0].select("left_id", "right_id")
    for p in pairs[1:]:
        out = out.union(p.select("left_id", "right_id"))
    return out.distinct()


def rekey(df: DataFrame, name: str, normaliser: Callable[[Column], Column], key: str = "key") -> DataFrame:
    return df.withColumn(key, normaliser(F.col(name)))


def coverage(pairs: DataFrame, truth: DataFrame, possible: int) -> DataFrame:
    """One row: recall (null without truth) and the share of possible pairs that need no look."""
    t, p = truth.select("left_id", "right_id").distinct(), pairs.select("left_id", "right_id").distinct()
    hits = t.join(p, ["left_id", "right_id"], "left_semi").agg(F.count("*").alias("found"))
    sizes = t.agg(F.count("*").alias("truths")).join(F.broadcast(p.agg(F.count("*").alias("pairs"))))
    return sizes.join(F.broadcast(hits)).select(
        "pairs", "truths", "found",
        F.try_divide("found", "truths").alias("recall"),
        (1 - F.try_divide(F.col("pairs"), F.lit(possible))).alias("reduction"),
    )


def recall_curve(candidates: DataFrame, truth: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Recall and number of pairs for several k from one ranked table with the largest k."""
    t = truth.select("left_id", "right_id").distinct().withColumn("true", F.lit(1))
    rows = candidates.join(t, ["left_id", "right_id"], "left")
    cuts = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    rows = rows.select("seq", "true", cuts).where(F.col("seq") <= F.col("k"))
    total = F.broadcast(t.agg(F.count("*").alias("truths")))
    return rows.groupBy("k").agg(F.count("*").alias("pairs"), F.count("true").alias("found")).join(total).select(
        "k", "pairs", "found", F.try_divide("found", "truths").alias("recall")
    )


def missed(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    return truth.select("left_id", "right_id").distinct().join(pairs, ["left_id", "right_id"], "left_anti")


def partner_counts(truth: DataFrame) -> DataFrame:
    """One row: records with several partners on each side, most partners, ceiling of one-to-one recall."""
    t = truth.select("left_id", "right_id").distinct()
    side = lambda c: t.groupBy(c).agg(F.count("*").alias("n")).agg(
        F.count("*").alias(c.replace("_id", "s")), F.count_if(F.col("n") > 1).alias(f"multi_{c}"), F.max("n").alias(f"most_{c}")
    )
    whole = t.agg(F.count("*").alias("truths"))
    return side("left_id").join(F.broadcast(side("right_id"))).join(F.broadcast(whole)).withColumn(
        "recall_ceiling", F.try_divide("rights", "truths")
    )
