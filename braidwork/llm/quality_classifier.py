"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has its own mean and covariance; covariances are shrunk towards the pooled one and that
towards its diagonal. A score is the difference of Mahalanobis log-densities, taken from cached
Cholesky factors and mapped to 0..1 by a logistic curve fitted on the same training rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

SYMBOLS = "#*$%&|<>"
#: At most so many labelled training rows, those of the lowest hash, are fitted on the driver.
SAMPLE = 20_000
TOWARDS_POOLED, TOWARDS_DIAGONAL = 0.2, 0.1
NEAR_ZERO = 1e-3
FEATURES = (
    "words", "word length", "symbols", "upper case", "distinct words", "repeated neighbours", "exclamations",
    "bars", "repeated lines", "digits", "other marks", "line length", "commonest word",
)


def _log_share(part: int, whole: int) -> float:
    return float(np.log((part + 0.01) / (whole + 1.0)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; null counts as empty."""
    text = text or ""
    found = text.split()
    n, size = len(found), len(text)
    counts = Counter(found)
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = sum(text.count(c) for c in SYMBOLS)
    letters = sum(map(len, found))
    lower = text.lower()
    upper = sum(map(str.isupper, text)) if lower != text else 0
    return [
        float(np.log1p(n)),
        float(np.log1p(letters / n)) if n else 0.0,
        _log_share(symbols, n),
        _log_share(upper, letters),
        _log_share(n - len(counts), n),
        _log_share(sum(map(str.__eq__, found, found[1:])), n),
        _log_share(text.count("!"), n),
        _log_share(text.count("|"), n),
        _log_share(len(lines) - len(set(lines)), len(lines)),
        _log_share(sum(text.count(d) for d in "0123456789"), size),
        _log_share(text.count(".") + text.count(","), n),
        float(np.log1p(size / len(lines))) if lines else 0.0,
        _log_share(max(counts.values(), default=0), n),
    ]


class Discriminant:
    """Two Gaussian classes with shrunk covariances and cached factors."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pooled: float = TOWARDS_POOLED, diagonal: float = TOWARDS_DIAGONAL):
        self.constant = None if len(set(y.tolist())) == 2 else float(y.mean()) if len(y) else 0.5
        if self.constant is not None:
            return
        self.low, self.high = x.min(0), x.max(0)
        spread = {k: np.cov(x[y == k].T, bias=True).reshape(x.shape[1], -1) for k in (0, 1)}
        share = {k: float((y == k).mean()) for k in (0, 1)}
        common = share[0] * spread[0] + share[1] * spread[1]
        common = (1 - diagonal) * common + diagonal * np.diag(np.diag(common)) + NEAR_ZERO * np.eye(len(common))
        self.mean, self.factor, self.offset = {}, {}, {}
        for k in (0, 1):
            lower = np.linalg.cholesky((1 - pooled) * spread[k] + pooled * common + NEAR_ZERO * np.eye(len(common)))
            self.mean[k], self.factor[k] = x[y == k].mean(0), np.linalg.inv(lower)
            self.offset[k] = np.log(share[k]) - np.log(np.diag(lower)).sum()
        self.slope, self.shift = self._logistic(self.difference(x), y)

    def difference(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, self.low, self.high)
        density = {k: self.offset[k] - 0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(1) for k in (0, 1)}
        return np.arcsinh(density[1] - density[0])

    @staticmethod
    def _logistic(d: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
        z, w = np.stack([d, np.ones_like(d)], 1), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (y - p) - ridge * w)
            w += np.clip(step, -2, 2)
        return float(w[0]), float(w[1])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -30, 30)))


def training_rows(docs: DataFrame, labelled: DataFrame, doc_id: str, text: str, label: str, sample: int) -> DataFrame:
    """Texts with their ``label`` for at most ``sample`` labelled rows, those of the lowest hash."""
    ids = labelled.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).dropna()
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    return docs.select(doc_id, text).join(F.broadcast(ids), F.col(doc_id) == F.col("_id")).select(F.col(text).alias("text"), "_label", "_id")


def fit(docs: DataFrame, labelled: DataFrame, label: str, doc_id="doc_id", text="text", sample: int = SAMPLE) -> Discriminant:
    """Fits on a bounded sample of labelled rows; with one class or none the score is a constant."""

    def measured(texts: list[str | None]) -> list:
        return [[statistics(t) for t in texts]]

    rows = map_texts(training_rows(docs, labelled, doc_id, text, label, sample), "text", measured, "x array<double>").collect()
    return Discriminant(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["_label"] for r in rows]))


def quality_scores(docs: DataFrame, model: Discriminant, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` for every row; null and empty texts are scored as texts without words.

    Repeated rows score alike; an empty table gives an empty result; other columns are not read.
    """

    def scored(texts: list[str | None]) -> list:
        return [model.scores(np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES)))]

    return map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", scored, "score double")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = lambda c: F.crc32(F.col(c).cast("string")) % 4 == 2
    model = fit(docs, labels.where(~held_out("doc_id")), "quality")
    return quality_scores(docs, model).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )
