"""Quality classifier: a regularised quadratic discriminant.

Each text becomes a short vector of statistics (shares of kinds of characters, repetition,
shape of words), transformed by square roots or logarithms. Both classes are Gaussian with
their own mean and a covariance shrunk towards its diagonal and the pooled one. The score is the
logistic of the difference of log densities, from Mahalanobis distances through Cholesky factors
that are computed once. The statistics of a few words scatter, so the difference is weakened by words / (words + ``few``), and
nearly all of a very short text's score is the share of class 1 among the labels; ``few`` is what makes labelled texts likeliest
that weren't learned from (two folds).

Learning takes up to ``PER_CLASS`` labelled texts of each class, chosen by a hash of doc_id; their
vectors are all that reaches the driver. Null and empty texts have a vector too, and so a score.
If either class has no labelled text, every score is the share of class 1 (0.5 without labels).
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import documents, filter_texts, held_out, labels, map_rows

PER_CLASS = 4000
THRESHOLD = 0.7
#: Weights of the pooled covariance, the diagonal, and a floor for each variance.
TO_POOLED, TO_DIAGONAL, FLOOR = 0.2, 0.1, 1e-3
#: Numbers of words at which a text's statistics may count by half; labels choose one.
FEW = (0.0, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
FEATURES = ("upper", "digit", "symbol", "mark", "pipe", "shout", "space", "repeat", "common", "distinct", "length", "lines", "ending")


def vector(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    ratio = lambda *codes: sum(int(counts[c]) for c in codes) / chars
    unique = Counter(words)
    lines = text.split("\n")
    return [
        math.sqrt(int(counts[65:91].sum()) / letters),
        math.sqrt(int(counts[48:58].sum()) / chars),
        math.sqrt(ratio(35, 36, 37, 38, 42, 64, 94, 95, 126)),
        math.sqrt(ratio(44, 46, 58, 59)),
        math.sqrt(ratio(124)),
        math.sqrt(ratio(33)),
        math.sqrt(ratio(32, 9, 10)),
        math.sqrt(sum(map(eq, words, words[1:])) / n),
        math.sqrt(max(unique.values(), default=0) / n) if n >= 20 else 0.2,
        math.log(0.05 + len(unique) / n ** 0.8) if n >= 20 else 0.0,
        math.log(1 + min(40.0, chars / n)),
        math.sqrt(1 - len(set(lines)) / len(lines)),
        math.sqrt(sum(w[-1].isalnum() for w in words) / n) if words else 0.9,
        float(len(words)),
    ]


@dataclass
class Model:
    prior: float
    means: np.ndarray | None = None
    #: Inverse Cholesky factors and half log determinants.
    factors: np.ndarray | None = None
    logdets: np.ndarray | None = None
    few: float = 0.0

    def odds(self, x: np.ndarray, few: float) -> np.ndarray:
        """x: vectors with the number of words behind."""
        n, x = x[:, -1], x[:, :-1]
        logs = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.factors[k].T
            logs.append(-0.5 * (z * z).sum(1) - self.logdets[k])
        return np.log(self.prior / (1 - self.prior)) + (logs[1] - logs[0]) * n / np.maximum(n + few, 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.odds(x, self.few), -60, 60)))


def discriminant(x: np.ndarray, y: np.ndarray, prior: float) -> Model:
    if len(np.unique(y)) < 2:
        return Model(prior)
    parts = [x[y == k][:, :-1] for k in (0, 1)]
    means = np.array([p.mean(0) for p in parts])
    own = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, own, strict=True)) / len(y)
    factors, logdets = [], []
    for c in own:
        c = (1 - TO_POOLED) * c + TO_POOLED * pooled
        c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c)) + FLOOR * np.eye(len(c))
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(lower))
        logdets.append(np.log(np.diag(lower)).sum())
    return Model(prior, means, np.array(factors), np.array(logdets))


def with_few(x: np.ndarray, y: np.ndarray, prior: float) -> Model:
    """The discriminant of all rows, with the ``few`` that tells each half best by a model of the other one."""
    model = discriminant(x, y, prior)
    if model.means is None:
        return model
    loss = dict.fromkeys(FEW, 0.0)
    for half in (0, 1):
        learn, judge = np.arange(len(y)) % 2 == half, np.arange(len(y)) % 2 != half
        part = discriminant(x[learn], y[learn], prior)
        if part.means is None:
            return model
        for few in FEW:
            loss[few] += np.logaddexp(0, -np.clip(part.odds(x[judge], few), -60, 60) * (2 * y[judge] - 1)).sum()
    model.few = min(FEW, key=loss.__getitem__)
    return model


def fit(docs: DataFrame, marks: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """A doc_id with several labels counts as its least one."""
    rows = marks.select(F.col(doc_id).alias("i"), F.col(label).alias("y")).where(F.col("y").isin(0, 1) & F.col("i").isNotNull() & ~held_out("i"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    if len(sizes) < 2:
        return Model(sizes.get(1, 0) / n if n else 0.5)
    scale = 1 << 40
    limit = F.when(F.col("y") == 0, min(scale, int(scale * per_class / sizes[0]) + 1)).otherwise(min(scale, int(scale * per_class / sizes[1]) + 1))
    chosen = rows.where(F.pmod(F.xxhash64(F.col("i"), F.lit("quality")), F.lit(scale)) < limit).groupBy("i").agg(F.min("y").alias("y"))
    # about 2 x per_class rows of two numbers, whatever the table: the bound is the parameter
    met = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("text")).join(F.broadcast(chosen), "i").select("y", "text")

    def make():
        return lambda columns: {"y": columns[0], "x": [vector(t) for t in columns[1]]}

    found = map_rows(met, make, "y int, x array<double>").collect()
    if not found:
        return Model(sizes[1] / n)
    found = sorted((r["x"], r["y"]) for r in found)
    return with_few(np.array([x for x, _ in found]), np.array([y for _, y in found]), sizes[1] / n)


def score(df: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; repeated rows give repeated rows."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def work(columns):
            found = own.scores(np.array([vector(t) for t in columns[2]])).tolist()
            return {"doc_id": columns[0], "held_out": columns[1], "score": found, "predicted": [int(s >= threshold) for s in found]}

        return work

    picked = df.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return map_rows(picked, make, "doc_id long, held_out boolean, score double, predicted int")


def filter_rows(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores ``threshold`` or more."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        return lambda texts: (own.scores(np.array([vector(t) for t in texts])) >= threshold).tolist()

    return filter_texts(df, make, text)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, labels(spark, sf_dir)))
