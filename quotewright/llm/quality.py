"""Document quality by hierarchical empirical Bayes over sites and their parts.

A logistic model on the form of a text gives each document's own evidence. Averages of
it over a host, and over each path of a host, are shrunk: a host's rate towards the
global one, a path's towards its host's, the more the fewer documents there are. How
strongly is estimated from how much the rates differ beyond chance. A document's
posterior adds its evidence to the prior of its path.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.llm.common import batches, stored, whole

#: Labelled documents that the fit uses at most, those with the smallest hash of their id.
MAX_LABELLED = 20_000
#: Range of the shrinkage, in documents.
SHRINK = (2.0, 1e6)
SYMBOLS = b"!#$%&*+/<=>@[\\]^_`{|}~"
STOPS = b".,;:?\"'()-"
DIGITS, UPPER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKED = re.compile(rb"[^\s\w\x80-\xff][^\s\w\x80-\xff]+(?=\s|$)")


def form(text: str) -> list[float]:
    """Features of how a text looks."""
    data = text.encode()
    words, lines = data.split(), data.split(b"\n")
    n, k = max(1, len(data)), max(1, len(words))

    def share(chars: bytes) -> float:
        return (len(data) - len(data.translate(None, chars))) / n

    return [
        math.log1p(len(words)), len(data) / k, share(SYMBOLS) ** 0.5, share(STOPS), share(DIGITS) ** 0.5, share(UPPER) ** 0.5,
        len(set(words)) / k, len(set(lines)) / len(lines), math.log1p(len(data) / len(lines)),
        min(1.0, sum(1 for _ in MARKED.finditer(data)) / k),
    ]


@dataclass(frozen=True)
class Evidence:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float  # log odds of the labelled share

    def log_odds(self, forms: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good against bad."""
        return expanded(forms, self.mean, self.scale) @ self.weights - self.base


def expanded(forms: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((forms - mean) / scale, -6, 6)
    return np.concatenate((np.ones((len(z), 1)), z, z * z), axis=1)


def fit_evidence(forms: np.ndarray, good: np.ndarray, penalty: float = 1.0) -> Evidence:
    """Logistic regression by Newton steps; without labels of both kinds it says nothing."""
    if not len(good) or good.all() or not good.any():
        width = forms.shape[1] if forms.ndim == 2 else len(form(""))
        return Evidence(np.zeros(width), np.ones(width), np.zeros(2 * width + 1), 0.0)
    mean, scale = forms.mean(axis=0), np.maximum(forms.std(axis=0), 1e-6)
    x = expanded(forms, mean, scale)
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-9
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge, x.T @ (good - p) - ridge @ w)
        w += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    rate = good.mean()
    return Evidence(mean, scale, w, math.log(rate / (1 - rate)))


def fit(docs: DataFrame, labels: DataFrame) -> Evidence:
    """Fit on at most MAX_LABELLED rows of ``docs`` with a label ``quality`` (0 or 1)."""
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    sample = docs.select("doc_id", whole().alias("text")).join(F.broadcast(chosen), "doc_id")  # broadcast: at most MAX_LABELLED pairs

    def run(rows: dict[str, list]) -> dict[str, list]:
        return {"good": rows["quality"], "form": [form(t) for t in rows["text"].to_pylist()]}

    found = batches(sample.select("quality", "text"), run, "good int, form array<double>").collect()
    return fit_evidence(np.array([r["form"] for r in found]), np.array([r["good"] == 1 for r in found]))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))


def shrinkage(groups: DataFrame) -> float:
    """Documents that the prior of a group is worth, by moments; ``groups`` has n, good and prior."""
    rate, chance = F.col("good") / F.col("n"), F.col("prior") * (1 - F.col("prior"))
    moments = groups.where("n >= 2").agg(
        F.sum(F.col("n") * (rate - F.col("prior")) ** 2).alias("spread"), F.sum(chance).alias("chance"),
        F.sum(F.col("n") * chance).alias("weighted"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    if not moments["k"] or moments["n"] <= moments["k"]:
        return SHRINK[1]
    # E[spread] = chance + v * (weighted - chance), v the share of the variance between groups
    v = (moments["spread"] - moments["chance"]) / max(1e-12, moments["weighted"] - moments["chance"])
    return min(SHRINK[1], max(SHRINK[0], 1 / v - 1)) if v > 0 else SHRINK[1]


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", cut: float = 0.5) -> DataFrame:
    """doc_id, score (posterior of good) and keep (score at least ``cut``) of every row of ``docs``.

    ``docs`` has doc_id, text and the columns ``host`` and ``path``; ``labels`` has
    doc_id and quality. A missing host or path is a group of its own, a missing text is
    empty. Repeated rows are judged alike. Without labels every score is 0.5.
    """
    model = fit(docs, labels)

    def run(rows: dict[str, list]) -> dict[str, list]:
        odds = model.log_odds(np.array([form(t) for t in rows["text"].to_pylist()]))
        return {"doc_id": rows["doc_id"], "host": rows["host"], "path": rows["path"], "evidence": odds}

    columns = docs.select("doc_id", whole().alias("text"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    judged = stored(batches(columns, run, "doc_id long, host string, path string, evidence double"), "evidence")
    rate = 1 / (1 + math.exp(-model.base))
    paths = stored(
        judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(_sigmoid(F.col("evidence") + model.base)).alias("good")), "paths")
    total = paths.agg(F.sum("good"), F.sum("n")).first()
    overall = float(total[0]) / float(total[1]) if total[1] else rate
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("prior", F.lit(overall))
    k = shrinkage(hosts)
    hosts = hosts.select("host", ((F.col("good") + k * F.col("prior")) / (F.col("n") + k)).alias("prior"))
    nested = stored(paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).select(paths["*"], "prior"), "path-priors")
    k = shrinkage(nested)
    priors = stored(nested.select(
        F.col("host").alias("h"), F.col("path").alias("p"), _logit((F.col("good") + k * F.col("prior")) / (F.col("n") + k)).alias("prior")), "priors")
    joined = judged.join(priors, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    score = F.round(_sigmoid(F.col("evidence") + F.col("prior")), 6)
    return joined.select("doc_id", score.alias("score")).withColumn("keep", F.col("score") >= cut)
