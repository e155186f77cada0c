"""Exact removal of repeated word sequences: seeds at winnowed anchors, extended both ways.

Anchors are the smallest hashes of GRAM words among the grams of each window of
``length`` words, so equal windows have equal anchors at equal places. A seed is an
anchor together with its extension: all the windows that chose it. Seeds with one
anchor are joined; those with equal extensions are equal as a whole, and only the
first of them is extended window by window against the other extensions. Equality is
by two independent 64-bit hashes, of the anchor and of the windows.

Documents are ordered by doc_id, missing ones last; places in a document by word.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotewright.llm.common import Memo, batches, order_id, shown_id, stored, whole, with_lists, worker_value

GRAM = 6
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
SEEDS = "anchor long, extension long, did long, text_id long, start int, windows int"


def word_hashes(words: list[bytes]) -> np.ndarray:
    memo = worker_value("word hashes", lambda: Memo(xxhash.xxh64_intdigest))
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    n = len(hashes) - width + 1
    out = hashes[:n].copy()
    for j in range(1, width):
        out *= BASE
        out += hashes[j : j + n]
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    return out


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value in every window of ``width`` values."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        span += step
    return at


def seeds_of(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, extension hash, first window and number of windows of every seed of a text."""
    grams, windows = rolled(hashes, GRAM), rolled(hashes, length)
    at = leftmost_minima(grams, length - GRAM + 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    counts = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, counts)
    powers = np.cumprod(np.full(length, MIX, dtype=np.uint64))
    extension = np.add.reduceat(windows * powers[place], first)
    return grams[at[first]], extension ^ (at[first] - first).astype(np.uint64), first, counts


def seeds(docs: DataFrame, length: int) -> DataFrame:
    """All seeds (SEEDS) of ``docs`` (did, text_id, text)."""

    def run(rows: dict[str, list]) -> dict[str, np.ndarray]:
        parts: list[tuple] = []
        for did, text_id, text in zip(*(rows[c].to_pylist() for c in ("did", "text_id", "text")), strict=True):
            words = text.encode().split()
            if len(words) >= length:
                anchor, extension, first, counts = seeds_of(word_hashes(words), length)
                parts.append((anchor.view(np.int64), extension.view(np.int64), np.full(len(first), did), np.full(len(first), text_id), first, counts))
        names = ("anchor", "extension", "did", "text_id", "start", "windows")
        return dict(zip(names, map(np.concatenate, zip(*parts, strict=True)) if parts else [[]] * 6, strict=True))

    return batches(docs, run, SEEDS)


def windows_of(docs: DataFrame, length: int) -> DataFrame:
    """Every window of the wanted seeds: ``docs`` has did, text_id, text and wanted, a list of (start, windows, anchor)."""

    def run(rows: dict[str, list]) -> dict[str, np.ndarray]:
        parts: list[tuple] = []
        for did, text_id, text, wanted in zip(*(rows[c].to_pylist() for c in ("did", "text_id", "text", "wanted")), strict=True):
            windows = rolled(word_hashes(text.encode().split()), length)
            start, counts, anchor = (np.array([w[c] for w in wanted]) for c in ("start", "windows", "anchor"))
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(start, counts)
            parts.append((np.repeat(anchor, counts), windows[place].view(np.int64), np.full(len(place), did), np.full(len(place), text_id), place))
        return dict(zip(("anchor", "window", "did", "text_id", "start"), map(np.concatenate, zip(*parts, strict=True)), strict=True))

    return batches(docs, run, "anchor long, window long, did long, text_id long, start int")


def _later(place: str = "first") -> F.Column:
    return F.struct("did", "start") > F.struct(f"{place}.did", f"{place}.start")


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """Windows that start earlier elsewhere, as ``spans`` (start, windows) of each did and text_id of ``docs``."""
    found = stored(seeds(docs, length), "seeds")
    # written first, so that the joins read plain shuffles, whose hot keys Spark can split
    shared = stored(found.groupBy("anchor").count().where("count > 1").select("anchor"), "shared-anchors")
    found = stored(found.join(shared, "anchor", "left_semi"), "shared-seeds")
    classes = stored(
        found.groupBy("anchor", "extension").agg(F.min(F.struct("did", "start", "text_id", "windows")).alias("first")), "seed-classes")
    copies = found.join(classes, ["anchor", "extension"]).where(_later()).select("did", "text_id", "start", "windows")

    several = stored(classes.groupBy("anchor").count().where("count > 1").select("anchor"), "several-classes")
    wanted = stored(
        classes.join(several, "anchor", "left_semi").select("first.*", "anchor")
        .groupBy("did", "text_id").agg(F.collect_list(F.struct("start", "windows", "anchor")).alias("wanted")), "wanted")
    texts = with_lists(docs, wanted, "wanted", only=True)
    windows = stored(windows_of(texts, length), "windows")
    firsts = stored(
        windows.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min(F.struct("did", "start")).alias("first"))
        .where("n > 1").drop("n"), "first-windows")
    parts = windows.join(firsts, ["anchor", "window"]).where(_later()).select("did", "text_id", "start", F.lit(1).alias("windows"))
    return copies.union(parts).groupBy("did", "text_id").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))


def substring_dedup(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text of every row of ``docs`` (doc_id, text).

    A word goes if a window of ``length`` words covers it that also starts earlier:
    in a document with a smaller doc_id, or further up in the same one. Windows are
    judged on the input. Kept words are joined by one space. A missing text has no
    words; rows without a doc_id come last and, like rows that share a doc_id, count
    as one document. Repeated rows all stay.
    """
    keyed = docs.select(order_id().alias("did"), F.xxhash64(whole()).alias("text_id"), whole().alias("text"))
    spans = stored(repeated_spans(keyed, length), "spans")

    def run(rows: dict[str, list]) -> dict[str, list]:
        n_words, n_removed, kept = [], [], []
        for text, cuts in zip(rows["text"].to_pylist(), rows["spans"].to_pylist(), strict=True):
            words = text.encode().split()
            n_words.append(len(words))
            if cuts:
                edges = np.zeros(len(words) + 1, dtype=np.int64)
                start = np.array([c["start"] for c in cuts])
                np.add.at(edges, start, 1)
                np.add.at(edges, start + np.array([c["windows"] for c in cuts]) + length - 1, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        return {"did": rows["did"], "n_words": n_words, "n_removed": n_removed, "text": kept}

    out = batches(with_lists(keyed, spans, "spans"), run, "did long, n_words long, n_removed long, text string")
    return out.select(shown_id("did").alias("doc_id"), "n_words", "n_removed", "text")
