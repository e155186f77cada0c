"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Texts are compared in lower case, with every run of other signs than letters and
digits as one space. Each benchmark item is covered by overlapping patterns of up to
PATTERN characters. A region that holds a pattern with at most k edits shares at least
m - q + 1 - k q of its q-grams with it, and all on diagonals that differ by k at most.
Shared q-grams are counted in overlapping diagonal bands; regions that reach the bound
are kept and verified by an alignment within the band.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from quotewright.llm.common import batches, stored, whole, with_rows

Q = 10
PATTERN, STRIDE = 80, 40
EDIT_SHARE = 0.05
#: Shorter items are too common to mean anything.
LEAST_CHARS = 40
#: Characters of the benchmark that one pass over the documents carries; more take more passes.
PASS_CHARS = 1_000_000
SIGNS = re.compile(r"[\W_]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 22
FOUND = "item_id long, start int, length int, edits int"


def normalised(text: str) -> str:
    return SIGNS.sub(" ", text.lower()).strip()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def gram_hashes(chars: np.ndarray) -> np.ndarray:
    """Hash of the Q characters from each place, mixed."""
    n = len(chars) - Q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    # widths 1, 2, 4, ... by doubling, then the rest
    with np.errstate(over="ignore"):
        part, width, power = chars + np.uint64(1), 1, MULTIPLIER
        while 2 * width <= Q:
            part = part[:-width] * power + part[width:]
            width, power = 2 * width, power * power
        if width < Q:
            rest = Q - width
            part = part[: len(part) - rest] * (MULTIPLIER ** np.uint64(rest)) + part[rest:]
        return part[:n] ^ (part[:n] >> np.uint64(31))


def slots(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes * MULTIPLIER) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Patterns:
    """The q-grams of all patterns, sorted by hash: pattern and place of each."""

    item: list[int]
    text: list[str]
    budget: np.ndarray
    bound: np.ndarray
    hashes: np.ndarray
    pattern: np.ndarray
    place: np.ndarray
    seen: np.ndarray  # by slot, whether any q-gram has it


def patterns_of(items: list[tuple[int, str]]) -> Patterns:
    item, text = [], []
    for item_id, raw in items:
        whole_text = normalised(raw or "")
        if len(whole_text) < LEAST_CHARS:
            continue
        last = max(0, len(whole_text) - PATTERN)
        for s in sorted({*range(0, last + 1, STRIDE), last}):
            item.append(item_id)
            text.append(whole_text[s : s + PATTERN])
    sizes = np.array([len(t) for t in text], dtype=np.int64)
    budget = (sizes * EDIT_SHARE).astype(np.int64)
    grams = [gram_hashes(codes(t)) for t in text]
    flat = np.concatenate(grams) if grams else np.empty(0, dtype=np.uint64)
    counts = np.array([len(g) for g in grams], dtype=np.int64)
    order = np.argsort(flat, kind="stable")
    seen = np.zeros(1 << FILTER_BITS, dtype=bool)
    seen[slots(flat)] = True
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return Patterns(item, text, budget, sizes - Q + 1 - budget * Q, flat[order],
                    np.repeat(np.arange(len(text)), counts)[order], place[order], seen)


def shared_grams(chars: np.ndarray, known: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pattern, place in it and place in ``chars`` of every shared q-gram in a region dense enough for any pattern."""
    hashes = gram_hashes(chars)
    flags = known.seen[slots(hashes)]
    least = int(known.bound.min())
    reach = PATTERN + int(known.budget.max())
    # a region has ``least`` hits within ``reach`` places; others cannot matter
    sums = np.concatenate(([0], np.cumsum(flags)))
    at = np.flatnonzero(flags)
    ahead = sums[np.minimum(at + reach, len(flags))] - sums[at]
    dense = np.zeros(len(flags) + 1, dtype=np.int64)
    starts = at[ahead >= least]
    np.add.at(dense, starts, 1)
    np.add.at(dense, np.minimum(starts + reach, len(flags)), -1)
    at = at[np.cumsum(dense)[at] > 0]
    low = np.searchsorted(known.hashes, hashes[at], side="left")
    n = np.searchsorted(known.hashes, hashes[at], side="right") - low
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return known.pattern[inside], known.place[inside], np.repeat(at, n)


def candidate_regions(chars: np.ndarray, known: Patterns) -> list[tuple[int, int, int]]:
    """(pattern, least diagonal, greatest diagonal) of the bands that reach their pattern's bound."""
    pattern, place, at = shared_grams(chars, known)
    if not len(pattern):
        return []
    width = known.budget[pattern] + 1
    diagonal = at - place + PATTERN
    found = []
    for shift in (0, 1):  # bands of 2 k + 2 diagonals that overlap by half: k + 1 neighbours share one
        band = (diagonal + shift * width) // (2 * width)
        key, counts = np.unique(pattern * (len(chars) + 4 * PATTERN) + band, return_counts=True)
        p, b = key // (len(chars) + 4 * PATTERN), key % (len(chars) + 4 * PATTERN)
        w = known.budget[p] + 1
        low = b * 2 * w - shift * w - PATTERN
        good = counts >= known.bound[p]
        found += zip(p[good].tolist(), low[good].tolist(), (low + 2 * w - 1)[good].tolist(), strict=True)
    return found


def banded_alignment(pattern: np.ndarray, chars: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int] | None:
    """Edits of the best alignment of ``pattern`` with diagonals within the band, and where it ends; None beyond ``budget``."""
    low, high = low - budget, high + budget
    width = high - low + 1
    far = budget + 1
    row = np.zeros(width, dtype=np.int64)  # row i, column d: best for i characters ending at place i + low + d
    steps = np.arange(width)
    for i, c in enumerate(pattern.tolist()):
        place = i + low + steps
        inside = (place >= 0) & (place < len(chars))
        same = np.zeros(width, dtype=bool)
        same[inside] = chars[place[inside]] == c
        replaced = np.where(inside, row + ~same, far)
        left_out = np.append(row[1:], far) + 1
        best = np.minimum(replaced, left_out)
        row = np.minimum.accumulate(best - steps) + steps
    d = int(row.argmin())
    return (int(row[d]), len(pattern) + low + d) if row[d] <= budget else None


def matches(text: str, known: Patterns) -> list[dict[str, int]]:
    """Verified regions: item_id, start, length and edits; places are in the normalised text."""
    chars = codes(text)
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for p, low, high in candidate_regions(chars, known):
        pattern, budget = known.text[p], int(known.budget[p])
        at = text.find(pattern, max(0, low - budget), max(0, high + budget) + len(pattern))
        hit = (0, at + len(pattern)) if at >= 0 else banded_alignment(codes(pattern), chars, low, high, budget)
        if hit:
            key = (known.item[p], max(0, hit[1] - len(pattern)))
            out[key] = min(out.get(key, hit), hit)
    return [{"item_id": i, "start": s, "length": end - s, "edits": e} for (i, s), (e, end) in sorted(out.items())]


def find_all(texts: list[str], known: Patterns) -> list[list[dict[str, int]]]:
    return [matches(normalised(t), known) if len(t) >= LEAST_CHARS * (1 - EDIT_SHARE) else [] for t in texts]


def passes(benchmark: DataFrame) -> Iterator[Patterns]:
    """The benchmark in parts that are small enough to send to every task."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(chars) // PASS_CHARS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for k in range(parts):
        known = patterns_of(sorted((r["item_id"], r["text"]) for r in items.where(part == k).collect()))
        if known.item:
            yield known


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, length and edits of every benchmark pattern found in ``docs`` (doc_id, text).

    ``benchmark`` has item_id and text; items without either, or shorter than
    LEAST_CHARS, are left out. Missing and empty texts hold nothing. Repeated rows and
    rows without a doc_id are searched like others.
    """
    found = None
    rows = docs.select("doc_id", whole().alias("text"))
    for known in passes(benchmark):

        def run(rows: dict[str, list], known: Patterns = known) -> dict[str, list]:
            return {"doc_id": rows["doc_id"], "found": find_all(rows["text"].to_pylist(), known)}

        schema = StructType([*StructType.fromDDL("doc_id long"), StructField("found", ArrayType(StructType.fromDDL(FOUND)))])
        part = batches(rows, run, schema).select("doc_id", F.inline("found"))
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], f"doc_id long, {FOUND}") if found is None else found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, regions, least edits and span of the regions."""
    return leaks(docs, benchmark).groupBy("doc_id", "item_id").agg(
        F.countDistinct("start").alias("regions"), F.min("edits").alias("edits"),
        F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark pattern, with all their columns."""
    clean = docs
    for known in passes(benchmark):
        row, texts = with_rows(clean)

        def run(rows: dict[str, list], known: Patterns = known, texts: Callable = texts) -> dict[str, list]:
            return {"row": rows["row"], "leaks": [bool(f) for f in find_all(texts(rows), known)]}

        kept = batches(row, run, StructType([row.schema["row"], StructField("leaks", BooleanType())]))
        clean = kept.where("not leaks").select("row.*")
    return clean
