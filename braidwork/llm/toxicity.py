"""Toxicity: a linear-chain conditional random field over tokens.

Documents carry the labels, so tokens are labelled first: in toxic training documents a token counts as
toxic when its form or one of its beginnings is found in so many toxic documents, and (almost) no others,
that chance is ruled out. A two-tag chain is trained on these tokens by gradient ascent. Then toxic
documents are tagged again by the chain's own marginals, given that at least one of their tokens is toxic,
and the chain is trained on, so that what stands between or beside toxic tokens can change its tag. Each
token has the features of its form and beginnings; tokens without any known feature share one background
potential, so the chain between two known tokens is a power of one matrix. Forward-backward marginals give
toxic spans with their offsets, and spans give the score of a document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, map_texts, table
from .quality_classifier import training_rows

#: At most so many labelled training rows, those of the lowest hash, with so many characters are fitted on the driver.
SAMPLE, SAMPLE_CHARS = 8_000, 64_000_000
PREFIXES = (4, 5, 6, 7, 8)
#: The features with the most support, if there are more.
MAX_FEATURES = 4_000
#: A feature needs so many groups of near copies, more than chance gives to so many features, and so few other documents.
MIN_GROUPS, CHANCE, MAX_OTHER_SHARE = 3, 1.0, 0.02
#: Tokens of a run of the training, runs worked out at a time, rounds of ascent and of tagging again.
WIDTH, CHUNK, ROUNDS, RETAGGED = 16, 20_000, 60, 2
#: Words whose potentials a worker remembers, in two generations.
CACHE = 40_000
EDGES = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>*#$%&|-_~`/\\"


def form(token: str) -> str:
    return token.lower().strip(EDGES)


def features(word: str) -> list[str]:
    return ["=" + word, *[word[:n] for n in PREFIXES if len(word) > n]] if word else []


def _groups(words: list[str]) -> tuple[int, ...]:
    """Minima of three hashes over the words: copies of a document mostly agree in each."""
    codes = np.array([zlib.crc32(w.encode()) for w in words] or [0], dtype=np.uint64)
    return tuple(int(((codes * np.uint64(m)) % np.uint64(4294967291)).min()) for m in (1, 2654435761, 2246822519))


def choose_features(docs: list[tuple[list[str], int]]) -> set[str]:
    """Features that tell toxic training documents from others, at most ``MAX_FEATURES``.

    Support counts groups of near copies, not documents; what is found in other documents is counted
    by word, so a beginning's count is never below the number of its documents. A feature of n groups
    would be found in toxic ones alone by chance with the share of toxic documents to the n-th power;
    over all features looked at, that may add up to ``CHANCE`` features.
    """
    outside = Counter()
    for words, y in docs:
        if not y:
            outside.update(set(words))
    own = {k: _groups(sorted(set(words))) for k, (words, y) in enumerate(docs) if y}
    support: dict[str, int] = {}
    for n in (0, *PREFIXES):  # one kind of feature at a time, which is what the driver holds
        of = lambda words: {"=" + w for w in words if w} if not n else {w[:n] for w in words if len(w) > n}  # noqa: B023, E731
        met = Counter()
        for words, y in docs:
            if y:
                met.update(of(set(words)))
        # Few features are in enough documents to be in enough groups, so groups are kept for those alone.
        inside = {f: (set(), set(), set()) for f, count in met.items() if count >= MIN_GROUPS}
        del met
        for k, groups in own.items():
            for f in of(set(docs[k][0])) & inside.keys():
                for seen, g in zip(inside[f], groups):
                    seen.add(g)
        support |= {f: m for f, seen in inside.items() if (m := min(map(len, seen))) >= MIN_GROUPS}
    share = min(0.5, (1 + sum(y for _, y in docs)) / (2 + len(docs)))
    least = math.ceil(math.log(max(1, len(support)) / CHANCE) / -math.log(share))
    support = {f: n for f, n in support.items() if n >= least}
    against = Counter()
    for w, n in outside.items():
        for f in features(w):
            if f in support:
                against[f] += n
    good = [(n, f) for f, n in support.items() if against[f] <= MAX_OTHER_SHARE * n]
    return {f for _, f in sorted(good, key=lambda p: (-p[0], p[1]))[:MAX_FEATURES]}


class Chain:
    """Tags 0 (clean) and 1 (toxic); potentials: feature weights for tag 1, a bias, a 2x2 transition."""

    def __init__(self, weights: dict[str, float], bias: float, transition: np.ndarray):
        self.weights, self.bias, self.transition = weights, bias, transition
        self.powers: dict[int, np.ndarray] = {}
        self.step = np.exp(transition) * np.array([1.0, np.exp(bias)])
        self.step /= np.abs(np.linalg.eigvals(self.step)).max()

    def potential(self, word: str) -> float | None:
        """What known features add to the bias; None for a word without any."""
        known = [self.weights[f] for f in features(word) if f in self.weights]
        return sum(known) if known else None

    def background(self, n: int) -> np.ndarray:
        """The messages over ``n`` unknown tokens: a power of one matrix, remembered for short distances."""
        if n not in self.powers:
            found = np.linalg.matrix_power(self.step, n)
            if n >= 4096:
                return found
            self.powers[n] = found
        return self.powers[n]

    def marginals(self, n: int, at: list[int], added: list[float]) -> list[float]:
        """Probability of tag 1 at the known tokens, by forward and backward messages over all ``n`` tokens."""
        if not at:
            return []
        emit = [np.array([1.0, np.exp(min(a, 50.0))]) for a in added]
        forward, message, before = [], np.array([1.0, np.exp(self.bias)]), 0
        for i, e in zip(at, emit):
            message = (message @ self.background(i - before)) * e
            message = message / message.sum()
            forward.append(message)
            before = i
        out, message, after = [0.0] * len(at), np.ones(2), n - 1
        for j in range(len(at) - 1, -1, -1):
            message = self.background(after - at[j]) @ message
            p = forward[j] * message
            out[j] = float(p[1] / p.sum())
            message = message * emit[j]
            message, after = message / message.sum(), at[j]
        return out

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "transition": self.transition}

    def __setstate__(self, state):
        self.__init__(**state)


class _Runs:
    """Training tokens as runs of ``WIDTH``: features by place, tags, and the document of each run."""

    def __init__(self, runs: list[list[tuple[int, ...]]], tags: list[list[int]], of: list[int], m: int):
        self.tag, self.of, self.m = np.array(tags), np.array(of), m
        sizes = np.array([len(fs) for run in runs for fs in run], dtype=np.int64)
        self.rows = np.repeat(np.arange(len(sizes)), sizes)
        self.cols = np.array([f for run in runs for fs in run for f in fs], dtype=np.int64)

    def chunks(self):
        """First run and one behind the last, and where their features lie."""
        for a in range(0, len(self.tag), CHUNK):
            b = min(len(self.tag), a + CHUNK)
            yield a, b, *np.searchsorted(self.rows, [a * WIDTH, b * WIDTH])

    def counted(self, tag: np.ndarray) -> np.ndarray:
        """How often each feature, the bias and each transition is met under these tags."""
        out = np.zeros(self.m + 5)
        np.add.at(out, self.cols, tag.ravel()[self.rows])
        out[self.m] = tag.sum()
        out[self.m + 1 :] = [((tag[:, :-1] == a) & (tag[:, 1:] == b)).sum() for a in (0, 1) for b in (0, 1)]
        return out

    def expected(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same under the chain of weights ``w``, and the marginal of tag 1 at every token."""
        m, out, all_p = self.m, np.zeros(self.m + 5), np.zeros(self.tag.shape)
        step = np.exp(w[m + 1 :].reshape(2, 2))
        for first, last, low, high in self.chunks():
            rows, cols, n = self.rows[low:high] - first * WIDTH, self.cols[low:high], last - first
            e = np.zeros(n * WIDTH)
            np.add.at(e, rows, w[cols])
            e = np.clip(e.reshape(n, WIDTH) + w[m], -40, 40)
            emit = np.stack([np.ones_like(e), np.exp(e)], 2)
            f, b = np.empty_like(emit), np.ones_like(emit)
            f[:, 0] = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
            for t in range(1, WIDTH):
                f[:, t] = (f[:, t - 1] @ step) * emit[:, t]
                f[:, t] /= f[:, t].sum(1, keepdims=True)
            for t in range(WIDTH - 2, -1, -1):
                b[:, t] = (b[:, t + 1] * emit[:, t + 1]) @ step.T
                b[:, t] /= b[:, t].sum(1, keepdims=True)
            p = f * b
            p /= p.sum(2, keepdims=True)
            pair = f[:, :-1, :, None] * step * (emit[:, 1:] * b[:, 1:])[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            np.add.at(out, cols, p[:, :, 1].ravel()[rows])
            out[m] += p[:, :, 1].sum()
            out[m + 1 :] += pair.sum((0, 1)).ravel()
            all_p[first:last] = p[:, :, 1]
        return out, all_p

    def tagged_again(self, w: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """Tags by marginals: in toxic documents tokens of a half or more and the likeliest; none in others."""
        _, p = self.expected(w)
        p[~toxic[self.of]] = 0.0
        most = np.zeros(len(toxic))
        np.maximum.at(most, self.of, p.max(1))
        return ((p >= 0.5) | ((p > 0) & (p == most[self.of][:, None]))).astype(int)


def train(docs: list[tuple[list[str], int]], rounds: int = ROUNDS, ridge: float = 1e-3, retagged: int = RETAGGED, transitions: bool = True) -> Chain:
    """Conditional likelihood of tagged training tokens, by gradient ascent with momentum of its exact gradient.

    Chains are cut into runs of ``WIDTH`` tokens: all that hold a token with a chosen feature, and the first
    and last run of every fourth document. Without ``transitions``, tokens are tagged each by itself.
    """
    chosen = choose_features(docs)
    if not chosen:
        return Chain({}, -9.0, np.zeros((2, 2)))
    index = {f: i for i, f in enumerate(sorted(chosen))}
    ids = {w: found for w in {w for words, _ in docs for w in words} if (found := tuple(index[f] for f in features(w) if f in index))}
    known = lambda w: ids.get(w, ())
    made, tags, of = [], [], []
    for k, (words, y) in enumerate(docs):
        starts = {i - i % WIDTH for i, w in enumerate(words) if known(w)}
        starts |= {0, max(0, len(words) - 1) // WIDTH * WIDTH} if k % 4 == 0 else set()
        for s in sorted(starts):
            run = words[s : s + WIDTH]
            made.append([known(w) for w in run] + [()] * (WIDTH - len(run)))
            tags.append([int(bool(y and f)) for f in made[-1]])
            of.append(k)
    m = len(index)
    runs, toxic, tag = _Runs(made, tags, of, m), np.array([bool(y) for _, y in docs]), np.array(tags)
    w = np.zeros(m + 5)
    w[m] = -4.0
    for again in range(1 + retagged):
        if again:
            tag = runs.tagged_again(w, toxic)
        true, speed = runs.counted(tag), np.zeros(m + 5)
        for _ in range(rounds if not again else rounds // 3):
            expected, _ = runs.expected(w)
            scale = np.maximum(1.0, np.maximum(true, expected))
            speed = 0.7 * speed + 0.5 * (true - expected - ridge * len(tag) * 0.01 * w) / scale
            if not transitions:
                speed[m + 1 :] = 0.0
            w += np.clip(speed, -1, 1)
    return Chain({f: float(w[i]) for f, i in index.items()}, float(w[m]), w[m + 1 :].reshape(2, 2).copy())


class potentials(dict):
    """What the chain adds at a token, for the tokens met lately."""

    def __init__(self, chain: Chain):
        super().__init__()
        self.chain, self.old = chain, {}

    def __missing__(self, token: str) -> float | None:
        found = self.old.get(token, 0)
        if found == 0:
            found = self.chain.potential(form(token))
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        if len(token) <= 48:
            self[token] = found
        return found


def tag_text(chain: Chain, text: str | None, cache: dict | None = None, least: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
    """The score of one whole text and its toxic spans: start, end (characters) and highest marginal.

    A span is a run of neighbouring tokens whose marginal is ``least`` or more; the score is the chance
    that at least one span (or, without spans, the likeliest token) is toxic. Texts without a known token
    score 0, empty ones too.
    """
    cache = potentials(chain) if cache is None else cache
    n, at, added = 0, [], []
    for a in map(cache.__getitem__, (text or "").split()):
        if a is not None:
            at.append(n)
            added.append(a)
        n += 1
    if not at:
        return 0.0, []
    p = chain.marginals(n, at, added)
    spans: list[list] = []
    for i, q in zip(at, p):
        if q >= least:
            if spans and spans[-1][1] == i - 1:
                spans[-1][1:] = [i, max(q, spans[-1][2])]
            else:
                spans.append([i, i, q])
    if not spans:
        return max(p), []
    where = [m.span() for m in re.finditer(r"\S+", text)]
    clean = 1.0
    for _, _, q in spans:
        clean *= 1 - q
    return 1 - clean, [(where[i][0], where[j][1], q) for i, j, q in spans]


def fit(docs: DataFrame, labelled: DataFrame, label: str = "toxic", doc_id="doc_id", text="text", sample: int = SAMPLE) -> Chain:
    """Trains on the driver, on a sample of labelled rows that ``sample`` and ``SAMPLE_CHARS`` bound.

    Without toxic rows, and without any row, the chain finds nothing.
    """
    forms: dict[str, str] = {}

    def words(x: str | None) -> list[str]:
        return [forms.setdefault(f, f) for f in map(form, (x or "").split())]

    rows, found, left = training_rows(docs, labelled, doc_id, text, label, sample), [], SAMPLE_CHARS
    for r in rows.orderBy(F.xxhash64("_id"), "_id").toLocalIterator():
        left -= len(r["text"] or "")
        if left < 0:
            break
        found.append((words(r["text"]), r["_label"]))
    forms.clear()
    chain = train(found)
    del found
    give_back()
    return chain


def toxicity(docs: DataFrame, chain: Chain, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns but the text, unless given) with ``score`` and ``spans`` of every row's whole text.

    Null and empty texts score 0; repeated rows score alike; an empty table gives an empty result; columns
    named ``score`` or ``spans`` are replaced. Very long texts are tagged whole.
    """
    made = {"score", "spans"}
    keep = [c for c in docs.columns if c != text and c not in made] if keep is None else keep
    cache: list = []

    def scored(texts: list[str | None]) -> list:
        if not cache:
            cache.append(potentials(chain))
        found = [tag_text(chain, t, cache[0]) for t in texts]
        spans = [[{"start": a, "end": b, "probability": q} for a, b, q in s] for _, s in found]
        return [[score for score, _ in found], spans]

    return map_texts(docs, text, scored, "score double, spans array<struct<start:int,end:int,probability:double>>", keep)


def without_toxic(docs: DataFrame, chain: Chain, limit: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below ``limit``, with all their columns but a ``_toxicity``.

    Null and empty texts score 0 and stay; repeated rows go or stay together; an empty table stays empty.
    """
    cache: list = []

    def scored(texts: list[str | None]) -> list:
        if not cache:
            cache.append(potentials(chain))
        return [[tag_text(chain, t, cache[0])[0] for t in texts]]

    rated = map_texts(docs, text, scored, "_toxicity double", docs.columns)
    return rated.where(F.col("_toxicity") < limit).select(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = lambda c: F.crc32(F.col(c).cast("string")) % 5 == 0
    chain = fit(docs, labels.where(~held_out("doc_id")))
    return toxicity(docs.select("doc_id", "text"), chain).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "spans",
    )
