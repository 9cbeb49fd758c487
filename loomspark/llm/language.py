"""Language identification by error-correcting output codes.

Every language has a codeword of +-1. Up to ``EXHAUSTIVE`` languages the code is the exhaustive one, every division of the
languages into two sides once, with half of the columns and one more apart (distance 4 for four languages); beyond, the best of
several dense random codes of about ten columns for each doubling. For each column a binary classifier over hashed byte
trigrams tells its two sides (log ratios of smoothed trigram shares). A text's margins are compared with all codewords under an
exponential loss in which a column counts by how far its classifier holds the sides apart, and the codeword of least loss wins;
``score`` is its share of ``exp(-loss)``, and texts whose share is under ``AMBIGUOUS`` are flagged.

Learning takes ``PER_LANGUAGE`` texts of each language, chosen by a hash of doc_id, and gathers
trigram sums (languages x ``BINS`` numbers) whatever the size of the table.

A null text, or one without a letter, is ``und`` with score 0. A text in a script that was
never seen is a tie: score 1/languages, flagged. Without anything to learn from, all are ``und``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import documents, filter_texts, held_out, map_rows

BINS = 1 << 16
#: Bound on the texts of a language that are learned from (as expected; the choice is by hash).
PER_LANGUAGE = 1500
AMBIGUOUS = 0.5
#: Languages up to which the code has all columns there are.
EXHAUSTIVE = 7
#: Pseudo-count of each bin; what a mean log ratio is multiplied by; the largest margin; and the trigrams that give a margin in full.
SMOOTH, GAIN, LIMIT, ENOUGH = 0.5, 4.0, 8.0, 40
_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
BLOCK = 1 << 20


def trigrams(text: str) -> np.ndarray:
    """Counts of the hashed byte trigrams of the lower-cased text; anything but letters is a space."""
    data = np.frombuffer(b" " + text.lower().encode().translate(_PLAIN) + b" ", np.uint8)
    counts = np.zeros(BINS, np.int64)
    for at in range(0, len(data) - 2, BLOCK):
        x = data[at : at + BLOCK + 2].astype(np.uint32)
        keys = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
        counts += np.bincount(keys >> np.uint32(16), minlength=BINS)
    return counts


def codewords(n: int) -> np.ndarray:
    """n rows of +-1, no two columns alike or opposite."""
    if n <= EXHAUSTIVE:
        columns = np.arange(1, 1 << max(0, n - 1))
        return np.array([np.ones(len(columns)), *(1.0 - 2 * (columns >> i & 1) for i in range(n - 1))]).reshape(n, -1)
    width = ceil(10 * log2(n))
    draw, best, apart = np.random.default_rng(n), None, -1
    for _ in range(50):
        rows = draw.choice([-1.0, 1.0], (n, width))
        distances = (width - rows @ rows.T) / 2 + width * np.eye(n)
        if distances.min() > apart:
            best, apart = rows, distances.min()
    return best


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    #: What each column counts for; one on average.
    trust: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        counts = trigrams(text)
        seen = np.flatnonzero(counts)
        totals = counts[seen] @ self.weights[seen]
        n = int(counts[seen].sum())
        # hashed trigrams of a script never seen meet known ones by chance: then little of the text is known
        known = int(counts[seen][self.weights[seen].any(1)].sum()) / n
        margins = np.clip(GAIN * known * totals / n * min(1.0, np.sqrt(n / ENOUGH)), -LIMIT, LIMIT)
        loss = np.exp(-self.codes * margins) @ self.trust
        share = np.exp(loss.min() - loss)
        best = int(loss.argmin())
        return self.languages[best], float(share[best] / share.sum())


def fit(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    rows = df.select(F.col(doc_id).alias("i"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("i"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, 0)), np.zeros((BINS, 0)), np.zeros(0))
    scale = 1 << 40
    limit = F.lit(None).cast("long")
    for name, n in sizes.items():
        limit = F.when(F.col("lang") == name, F.lit(min(scale, int(scale * per_language / n) + 1))).otherwise(limit)
    sample = rows.where(F.pmod(F.xxhash64(F.col("i"), F.lit("lang")), F.lit(scale)) < limit).select("lang", "text")

    languages = sorted(sizes)
    number = {name: i for i, name in enumerate(languages)}

    def make():
        def work(columns):
            out = {"lang": [], "bin": [], "n": []}
            sums: dict[int, np.ndarray] = {}
            for name, value in zip(*columns, strict=True):
                counts, k = trigrams(value), number[name]
                sums[k] = sums[k] + counts if k in sums else counts
            for k, counts in sums.items():
                bins = np.flatnonzero(counts)
                out["lang"] += [k] * len(bins)
                out["bin"] += bins.tolist()
                out["n"] += counts[bins].tolist()
            return out

        return work

    # as columns of numbers: 16 bytes for each language and trigram that meet
    summed = map_rows(sample, make, "lang int, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(languages), BINS))
    table[summed["lang"].to_numpy(), summed["bin"].to_numpy()] = summed["n"].to_numpy()
    met = table.any(1)
    return learned([name for name, some in zip(languages, met, strict=True) if some], table[met])


def learned(languages: list[str], table: np.ndarray) -> Model:
    """The model of a table of trigram counts, a row for each language."""
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((BINS, 0)), np.zeros(0))
    # in proportion to a language's trigrams, so that one which nobody has speaks for nobody
    table = table + SMOOTH * table.sum(1, keepdims=True) / max(1.0, table.sum(1).mean())
    shares = table / table.sum(1, keepdims=True)
    codes = codewords(len(languages))
    weights = np.zeros((BINS, codes.shape[1]), np.float32)
    trust = np.ones(codes.shape[1])
    for j, column in enumerate(codes.T):
        one, other = shares[column > 0].mean(0), shares[column < 0].mean(0)
        ratio = np.log(one) - np.log(other)
        weights[:, j] = ratio
        trust[j] = (ratio * (one - other)).sum()
    return Model(languages, codes, weights, trust / max(trust.mean(), 1e-9) if len(trust) else trust)


def identify(df: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; the model is of fixed size for so many languages."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def work(columns):
            found = [own.predict(x) for x in columns[2]]
            return {"doc_id": columns[0], "held_out": columns[1], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "ambiguous": [x[1] < AMBIGUOUS for x in found]}

        return work

    picked = df.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return map_rows(picked, make, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def filter_rows(df: DataFrame, model: Model, text: str = "text", least: float = 0.0) -> DataFrame:
    """The rows whose text has a language, with a score of ``least`` or more."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def accept(texts):
            found = [own.predict(t) for t in texts]
            return [name != "und" and score >= least for name, score in found]

        return accept

    return filter_texts(df, make, text)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))
