"""Severity of toxic language by a cumulative-link ordinal regression on sparse word counts.

Words and word beginnings that separate labelled toxic from other documents are the
features. Labelled documents get ordered grades: 0 not toxic, and toxic ones up to
GRADES - 1 by how many telling words they hold. One weight vector serves all ordered thresholds:
P(grade > j) = sigmoid(w.x - t_j). The expected severity is the sum of these.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quotewright.llm.common import Memo, batches, whole, with_rows

#: Labelled documents that the fit uses at most, those with the smallest hash of their id.
MAX_LABELLED = 20_000
#: Features at most, and the least log-likelihood ratio of one.
MAX_UNITS, LEAST_G2 = 512, 30.0
GRADES = 3
#: Lengths of the word beginnings that are features.
BEGINNINGS = (3, 4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")


class Severity:
    """Units (words, or beginnings marked with ^), one weight for each, and ascending thresholds."""

    def __init__(self, units: list[str], weights: np.ndarray, thresholds: np.ndarray):
        self.units, self.weights, self.thresholds = {u: i for i, u in enumerate(units)}, weights, thresholds
        self.at = Memo(lambda word: tuple(i for u in units_of(word) if (i := self.units.get(u)) is not None))

    def features(self, text: str) -> tuple[np.ndarray, int]:
        """Log counts of the units, and the number of words that have any."""
        counts, telling = np.zeros(len(self.weights)), 0
        if self.units:
            for found in filter(None, map(self.at.__getitem__, WORD.findall(text.lower()))):
                telling += 1
                for i in found:
                    counts[i] += 1
        return np.log1p(counts), telling

    def above(self, texts: list[str]) -> np.ndarray:
        """P(grade > j) of every text for every threshold j."""
        x = np.array([self.features(t)[0] for t in texts])
        return _sigmoid((x @ self.weights)[:, None] - self.thresholds)


def units_of(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def telling_units(sample: DataFrame) -> list[str]:
    """Units by log-likelihood ratio between toxic and other documents of ``sample`` (text, toxic), those of toxic ones only."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    starts = [F.transform(F.filter(words, lambda w, n=n: F.char_length(w) > n), lambda w, n=n: F.concat(F.lit("^"), F.substring(w, 1, n))) for n in BEGINNINGS]
    total = sample.agg(F.sum("toxic"), F.count("*")).first()
    bad, n = float(total[0] or 0), float(total[1])
    if not bad or bad == n:
        return []
    counts = sample.select("toxic", F.explode(F.array_distinct(F.concat(words, *starts))).alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("k"))

    def part(seen: F.Column, expected: F.Column) -> F.Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, k = F.col("a"), F.col("k")
    g2 = 2 * (part(a, k * bad / n) + part(k - a, k * (n - bad) / n) + part(bad - a, (n - k) * bad / n) + part(n - bad - k + a, (n - k) * (n - bad) / n))
    chosen = counts.where(a / k > bad / n).select("word", g2.alias("g2")).where(F.col("g2") >= LEAST_G2)
    return [r["word"] for r in chosen.orderBy(F.desc("g2"), "word").limit(MAX_UNITS).collect()]


def grades(toxic: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """Ordered grades; toxic documents are split into equal parts by their number of telling words."""
    out = np.zeros(len(toxic), dtype=np.int64)
    if toxic.any():
        cuts = np.quantile(telling[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
        out[toxic] = 1 + (telling[toxic][:, None] > cuts).sum(axis=1)
    return out


def fit_ordinal(x: np.ndarray, grade: np.ndarray, penalty: float = 0.1, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the proportional-odds model by penalised maximum likelihood (Adam)."""
    n, d = x.shape
    # parameters: weights, first threshold, logs of the gaps between thresholds
    p = np.concatenate((np.zeros(d), [1.0], np.zeros(GRADES - 2)))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, first, gaps = p[:d], p[d], np.exp(p[d + 1 :])
        t = first + np.concatenate(([0.0], np.cumsum(gaps)))
        q = np.concatenate((np.ones((n, 1)), _sigmoid((x @ w)[:, None] - t), np.zeros((n, 1))), axis=1)
        probability = np.maximum(q[np.arange(n), grade] - q[np.arange(n), grade + 1], 1e-12)
        slope = q * (1 - q)  # d q / d (w.x - t)
        at, up = slope[np.arange(n), grade], slope[np.arange(n), grade + 1]
        dz = -(at - up) / probability
        dt = np.zeros((n, GRADES + 1))
        dt[np.arange(n), grade] += at / probability
        dt[np.arange(n), grade + 1] -= up / probability
        dt = dt[:, 1:-1].sum(axis=0)
        tail = np.cumsum(dt[::-1])[::-1]
        g = np.concatenate((x.T @ dz + penalty * w, [tail[0]], tail[1:] * gaps)) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:d], p[d] + np.concatenate(([0.0], np.cumsum(np.exp(p[d + 1 :]))))


def fit(docs: DataFrame, labels: DataFrame) -> Severity:
    """Fit on at most MAX_LABELLED rows of ``docs`` (doc_id, text) with a label ``toxic`` (0 or 1).

    Without labels of both kinds, or without telling units, nothing is toxic.
    """
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    sample = docs.select("doc_id", whole().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic").cache()  # broadcast: at most MAX_LABELLED pairs
    try:
        units = telling_units(sample)
        model = Severity(units, np.zeros(max(1, len(units))), np.full(GRADES - 1, math.inf))
        if not units:
            return model

        def counted(rows: dict[str, list]) -> dict[str, list]:
            dense, telling = zip(*map(model.features, rows["text"].to_pylist()), strict=True)
            return {"toxic": rows["toxic"], "telling": telling, "at": [np.flatnonzero(x) for x in dense], "x": [x[x > 0] for x in dense]}

        found = batches(sample, counted, "toxic int, telling long, at array<int>, x array<double>").collect()
    finally:
        sample.unpersist()
    x = np.zeros((len(found), len(units)))
    for row, r in zip(x, found, strict=True):
        row[r["at"]] = r["x"]
    grade = grades(np.array([r["toxic"] == 1 for r in found]), np.array([r["telling"] for r in found]))
    return Severity(units, *fit_ordinal(x, grade))


def score(docs: DataFrame, model: Severity, cut: float = 0.5) -> DataFrame:
    """doc_id, severity (0 to GRADES - 1), grade (the likeliest by threshold) and toxic (P(grade > 0) over ``cut``)."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        above = model.above(rows["text"].to_pylist())
        return {
            "doc_id": rows["doc_id"], "severity": np.round(above.sum(axis=1), 6),
            "grade": (above > 0.5).sum(axis=1).astype(np.int32), "toxic": above[:, 0] > cut}

    return batches(docs.select("doc_id", whole().alias("text")), run, "doc_id long, severity double, grade int, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Severity of every row of ``docs`` (doc_id, text), fitted on ``labels`` (doc_id, toxic).

    Missing and empty texts have no features. Repeated rows and rows without a doc_id
    are scored like others; other columns are ignored.
    """
    return score(docs, fit(docs, labels))


def without_toxic(docs: DataFrame, fitted_on: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model fitted on ``fitted_on`` does not call toxic, with all their columns."""
    model = fit(fitted_on, labels)
    row, texts = with_rows(docs)

    def run(rows: dict[str, list]) -> dict[str, list]:
        return {"row": rows["row"], "toxic": model.above(texts(rows))[:, 0] > cut}

    kept = batches(row, run, StructType([row.schema["row"], StructField("toxic", BooleanType())]))
    return kept.where("not toxic").select("row.*")
