"""Best-fit packing by linear grouping.

Documents become pieces of at most ``capacity`` tokens. What matters for packing is only how many pieces
there are of each length, at most ``capacity`` numbers at any input size, so the plan is made on the
driver from that histogram:

1. Large lengths are dealt, longest first, into groups of equal numbers of pieces and rounded up to the
   longest of their group.
2. For the few rounded lengths, configurations (which groups share a sequence) are optimised as a linear
   program by column generation and rounded to whole numbers; what is left over is placed by best fit.
3. Actual pieces replace the rounded ones, run by run of equal lengths, which frees room again.
4. Small pieces are placed by best fit into that room, then into new sequences.

Pieces are then numbered within their length, by counts per bucket and rank within the bucket, and looked
up in the plan. No task holds all pieces of a length.
"""

from __future__ import annotations

import re
import sys
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, stored, table

CAPACITY = 4096
#: Pieces longer than this part of the capacity are large.
LARGE = 1 / 3
GROUPS = 32
#: Column generation ends when no configuration would save more than this part of a sequence.
NEARLY = 1e-4
#: Pieces of one length are numbered in so many buckets.
BUCKETS = 64


def simplex(columns: list[np.ndarray], demand: np.ndarray, price_out, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Least number of columns that cover ``demand``; ``price_out`` gives a better column for dual prices."""
    basis = np.array(columns, dtype=float).T
    names = [c.copy() for c in columns]
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        level = inverse @ demand
        duals = inverse.sum(0)  # each column costs 1
        new = price_out(duals)
        if new is None:
            break
        direction = inverse @ new
        ratio = np.where(direction > 1e-9, level / np.where(direction > 1e-9, direction, 1.0), np.inf)
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        basis[:, leaves], names[leaves] = new, new.copy()
    level = np.maximum(np.linalg.inv(basis) @ demand, 0.0)
    return list(zip(names, level.tolist()))


def knapsack(sizes: list[int], capacity: int):
    """A pricing function: the configuration of the highest dual value, if that exceeds 1."""

    def best(duals: np.ndarray) -> np.ndarray | None:
        order = np.flatnonzero(duals > 1e-12)
        if not len(order):
            return None
        size, dual = np.array(sizes)[order], duals[order]
        smallest = int(size.min())
        value, took = np.zeros(capacity + 1 + int(size.max())), np.full(capacity + 1, -1, dtype=np.int64)
        shift = int(size.max())
        value[:shift] = -np.inf  # the rooms below 0
        for room in range(smallest, capacity + 1):
            options = value[shift + room - size] + dual
            k = int(options.argmax())
            before = value[shift + room - 1]
            if options[k] > before + 1e-12:
                value[shift + room], took[room] = options[k], k
            else:
                value[shift + room] = before
        if value[shift + capacity] <= 1 + NEARLY:
            return None
        found, room = np.zeros(len(sizes)), capacity
        while room > 0:
            if took[room] < 0:
                room -= 1
            else:
                found[order[took[room]]] += 1
                room -= int(size[took[room]])
        return found

    return best


def group_lengths(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> list[tuple[int, dict[int, int]]]:
    """(rounded length, lengths in it with their counts), longest first; equal numbers of pieces each."""
    total = sum(histogram.values())
    share, out, left = -(-total // groups) if total else 1, [], 0
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            if not left:
                out.append((length, {}))
                left = share
            k = min(n, left)
            out[-1][1][length] = out[-1][1].get(length, 0) + k
            n, left = n - k, left - k
    return out


class Room:
    """Runs of equal sequences by free room; the tightest fit comes first."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, how many)
        self.sizes: list[int] = []
        self.next = 0

    def add(self, room: int, first: int, n: int) -> None:
        if room > 0 and n:
            if not self.runs[room]:
                insort(self.sizes, room)
            self.runs[room].append((first, n))

    def take(self, length: int, n: int) -> tuple[int, int, int] | None:
        """At most ``n`` sequences of one run with the least room for ``length``: room, first, how many."""
        i = bisect_left(self.sizes, length)
        if i == len(self.sizes):
            return None
        room = self.sizes[i]
        first, m = self.runs[room].pop()
        if m > n:
            self.runs[room].append((first + n, m - n))
        elif not self.runs[room]:
            self.sizes.pop(i)
        return room, first, min(m, n)

    def new(self, n: int) -> int:
        self.next += n
        return self.next - n


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, from rank, number, first sequence, offset): where the pieces of each length go.

    Its size depends on the capacity and the number of groups, not on the number of pieces.
    """
    room, used, out = Room(), defaultdict(int), []

    def put(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, used[length], n, first, offset))
        used[length] += n

    full = histogram.get(capacity, 0)
    if full:
        put(capacity, full, room.new(full), 0)
    large = {k: n for k, n in histogram.items() if LARGE * capacity < k < capacity and n}
    grouped = group_lengths(large, capacity)
    sizes = [size for size, _ in grouped]
    if sizes:
        demand = np.array([sum(of.values()) for _, of in grouped], dtype=float)
        start = [np.eye(len(sizes))[k] * (capacity // size) for k, size in enumerate(sizes)]
        found = simplex(start, demand, knapsack(sizes, capacity))
        left = [sorted(of.items()) for _, of in grouped]  # longest last

        def draw(k: int, n: int) -> list[tuple[int, int]]:
            taken = []
            while n and left[k]:
                length, m = left[k].pop()
                if m > n:
                    left[k].append((length, m - n))
                taken.append((length, min(m, n)))
                n -= taken[-1][1]
            return taken

        for column, level in sorted(found, key=lambda p: -p[1]):
            kinds = [k for k in range(len(sizes)) for _ in range(round(column[k]))]
            have = {k: sum(m for _, m in left[k]) // kinds.count(k) for k in set(kinds)}
            n = min([int(level + 1e-6), *have.values()])
            if not n:
                continue
            first = room.new(n)
            # A run of sequences (first, number, filled) is split wherever the drawn length changes.
            runs = [(first, n, 0)]
            for k in kinds:
                drawn, split = draw(k, n)[::-1], []
                for at, m, filled in runs:
                    while m:
                        length, have_n = drawn.pop()
                        t = min(m, have_n)
                        put(length, t, at, filled)
                        split.append((at, t, filled + length))
                        if have_n > t:
                            drawn.append((length, have_n - t))
                        at, m = at + t, m - t
                runs = split
            for at, m, filled in runs:
                room.add(capacity - filled, at, m)
        rest = defaultdict(int)
        for of in left:
            for length, m in of:
                rest[length] += m
    else:
        rest = defaultdict(int)
    for length, n in histogram.items():
        if length not in large and length != capacity and n:
            rest[length] += n
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            got = room.take(length, n)
            if got:
                size, first, m = got
                put(length, m, first, capacity - size)
                room.add(size - length, first, m)
                n -= m
            else:
                # New sequences take as many pieces of this length as they hold.
                each = capacity // length
                m = max(1, n // each)
                first = room.new(m)
                k = min(each, n)
                for j in range(k):
                    put(length, m, first, j * length)
                room.add(capacity - k * length, first, m)
                n -= k * m
    return out


def pieces(docs: DataFrame, tokenize, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: the columns of ``docs`` but the text, piece, start, length and ids_crc32.

    ``tokenize`` makes a function from a text to the bytes of its little-endian unsigned 32-bit ids, on
    the executors.
    """
    made: list = []

    def cut(texts: list[str | None]) -> list:
        if not made:
            made.append(tokenize())
        out = []
        for t in texts:
            ids = made[0](t or "")
            n = len(ids) // 4
            out.append([
                {"piece": k, "start": a, "length": min(capacity, n - a), "ids_crc32": zlib.crc32(ids[4 * a : 4 * (a + capacity)])}
                for k, a in enumerate(range(0, n, capacity))
            ])
        return [out]

    kept = [c for c in docs.columns if c != text and c not in ("piece", "start", "length", "ids_crc32")]
    found = map_texts(docs, text, cut, "_p array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>", kept)
    return found.select(*kept, F.inline("_p"))


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    ``rows`` is read more than once and has to be the same each time, as a stored table is.
    """
    spark = rows.sparkSession
    kept = rows.columns
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*kept), F.lit(BUCKETS)).cast("int"))
    counts = rows.groupBy("length", "_bucket").agg(F.count("*").alias("n")).collect()  # capacity x BUCKETS at most
    histogram, base = defaultdict(int), []
    for r in sorted(counts, key=lambda r: (r["length"], r["_bucket"])):
        base.append((r["length"], r["_bucket"], histogram[r["length"]]))
        histogram[r["length"]] += r["n"]
    runs = sorted(plan(dict(histogram), capacity))
    # One number orders both the runs and the pieces: length first, rank next.
    width = 1 << 44
    starts = np.array([length * width + rank for length, rank, *_ in runs], dtype=np.int64)
    first = np.array([r[3] for r in runs], dtype=np.int64)
    offset = np.array([r[4] for r in runs], dtype=np.int64)
    rank_from = np.array([r[1] for r in runs], dtype=np.int64)
    bases = spark.createDataFrame(base, "length bigint, _bucket int, _base bigint")
    by_bucket = Window.partitionBy("length", "_bucket").orderBy(F.xxhash64(*kept), *kept)
    ranked = rows.withColumn("_rank", F.row_number().over(by_bucket) - 1)
    ranked = ranked.join(F.broadcast(bases), ["length", "_bucket"]).select(*kept, (F.col("_base") + F.col("_rank")).alias("_rank"))

    def looked_up(batches):
        import pyarrow as pa

        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = b.column(b.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            i = np.searchsorted(starts, length * width + rank, side="right") - 1
            new = [pa.array(first[i] + rank - rank_from[i]), pa.array(offset[i])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in kept) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(looked_up, schema)


def pack(docs: DataFrame, tokenize, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row per piece with its place: ``sequence_id`` (from 0) and ``offset`` in it, without gaps.

    Null texts count as empty and have the final id alone; repeated rows are packed each; very long texts
    are cut into pieces of ``capacity`` and a rest; an empty table gives an empty result; other columns
    pass through, those named as a column of the result are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("sequence_id", "offset")])
    return place(stored(pieces(docs, tokenize, text, capacity), "pieces"), capacity)


class Remembered(dict):
    """What ``make`` gave for the words met lately: two generations of at most ``most`` short words each."""

    def __init__(self, make, most: int, longest: int = 48):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


#: Tokenize functions of this worker: its tasks share the vocabulary and what is remembered.
_LOADED: dict[tuple[str, int], object] = {}
#: Words and parts of words that a generation remembers; an entry takes some 200 bytes.
WORDS, PARTS = 20_000, 220_000


def loaded(path: str, end: int):
    """The tokenize function of a vocabulary file, made once in a worker."""
    if (path, end) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, end] = _load(path, end)
    return _LOADED[path, end]


def _load(path: str, end: int):
    import json
    from array import array

    import regex
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    model = whole.model
    with open(path) as file:
        pattern = json.load(file)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    split = regex.compile(pattern).findall
    # Printable ASCII, Latin-1 and Latin Extended-A without the two letters that change by context or in number.
    plain = regex.compile(r"[\x21-\x7e¡-¬®-įı-ňŊ-ž]+").fullmatch
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    last = int(end).to_bytes(4, "little")

    def packed(ids: list[int]) -> bytes:
        found = array("I", ids)
        if found.itemsize != 4 or sys.byteorder != "little":
            return np.array(ids, dtype="<u4").tobytes()
        return found.tobytes()

    def of_part(part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(letters)
        return packed([t.id for t in model.tokenize(shown)])

    parts = Remembered(of_part, PARTS)

    def of_word(word: str) -> bytes:
        if plain(word) and "<|" not in word:
            return b"".join([parts[p] for p in split(word.lower())])
        return packed(whole.encode(word, add_special_tokens=False).ids)

    words = Remembered(of_word, WORDS)
    # The same parts for whole texts of plain letters, digits and marks, whose numbers are the ten digits.
    small = re.escape("".join(c for c in map(chr, range(0xA1, 0x17F)) if plain(c) and c.isalpha() and c.lower() == c))
    find = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{small}]+|[0-9]|[^\sa-z{small}0-9]+").findall
    odd = re.compile("[^\x20-\x7e\n¡-¬®-įı-ňŊ-ž]|[²³¹¼-¾]|<\\|").search

    def tokenize(text: str) -> bytes:
        if odd(text):
            return b"".join(map(words.__getitem__, text.replace("\n", " ").split(" "))) + last
        found = find(text.lower())
        return (b"".join(itemgetter(*found)(parts)) if len(found) > 1 else b"".join(map(parts.__getitem__, found))) + last

    return tokenize


def word_bpe(path: str, end: int = 1):
    """A maker of tokenize functions for a vocabulary file of the lower-case word kind: ids, then ``end``.

    Such tokenizers treat blanks as borders and cut words into letters, digits and marks, so these parts are
    encoded one by one and remembered, up to a bounded number. Texts and words of plain letters and marks take
    this short way through the file's model; any other word is left to the tokenizer as a whole. Both ways
    give the tokenizer's own ids.
    """
    return lambda: loaded(path, end)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, word_bpe(public_tokenizers.path("word_bpe_49k.json")))
