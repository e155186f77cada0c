"""Texts with like sets of word shingles, which SimHashes of 64 bits miss.

Two texts that share four fifths of their five-word shingles differ in about ten of 64
SimHash bits, far beyond what anchors can reach. So what is left by them is searched by
minima: BANDS groups of ROWS minima of hashed shingles, of which two texts of similarity
s share one with probability 1 - (1 - s^ROWS)^BANDS, 0.999 at 0.8. Whole shingle sets are
compared. Texts of equal sets are one class. A first pass compares all texts with a
common band with the smallest, the greatest and a hashed choice among its ids, which
covers a band of up to three texts and joins most groups in linear work. Where a larger
band then still holds texts of different groups, the rest is compared in full: all pairs
of the texts outside its largest group, and each of them with all of that group, in cells
of two parts of about PART texts. So no pair with a common band is left out but those
whose link could join nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotewright.llm.common import batches, connected, possible, stored, whole
from quotewright.llm.substrings import BASE, MIX, rolled, word_hashes

BANDS, ROWS = 18, 5
#: Odd factors of the hash functions.
FACTORS = np.random.default_rng(7).integers(1 << 62, (1 << 63) - 1, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
#: Shingles hashed at once.
HASHED = 1024
#: Texts in a part of a large band, about; a task compares two parts at a time.
PART = 512


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted 32-bit hashes of the shingles of a text, lower-cased in A-Z; of fewer words the whole sequence."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint32)
    hashes = rolled(word_hashes(words), min(width, len(words)))
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))


def bands(shingles: np.ndarray) -> np.ndarray:
    """One key for each band of a set that is not empty."""
    least = np.full(len(FACTORS), ~np.uint64(0))
    for at in range(0, len(shingles), HASHED):
        part = shingles[at : at + HASHED].astype(np.uint64) + np.uint64(1)
        np.minimum(least, (part[:, None] * FACTORS).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        keys = (keys * BASE + rows[:, j]) * MIX
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def banded(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, digest of the set and bands of every row of ``docs`` (doc_id, text) that has both an id and words."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        sets = ((d, shingle_set(t, width)) for d, t in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True))
        found = [(d, hashlib.sha256(s.tobytes()).digest(), bands(s)) for d, s in sets if len(s)]
        return {"doc_id": [d for d, _, _ in found], "same": [h for _, h, _ in found], "bands": [k for _, _, k in found]}

    rows = docs.where("doc_id is not null").select("doc_id", whole().alias("text"))
    return batches(rows, run, "doc_id long, same binary, bands array<long>")


def candidates(known: DataFrame) -> DataFrame:
    """Pairs doc_id, other of the first pass: every text with the chosen ones of its bands."""
    flat = known.select("doc_id", F.explode("bands").alias("band"))
    hashed = F.min_by("doc_id", F.xxhash64("doc_id", "band"))
    chosen = stored(
        flat.groupBy("band").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), hashed.alias("c"))
        .where("a <> b").select("band", F.array_distinct(F.array("a", "b", "c")).alias("others")), "chosen-texts")
    pairs = flat.join(chosen, "band").select("doc_id", F.explode("others").alias("other")).where("doc_id <> other")
    return pairs.select(F.greatest("doc_id", "other").alias("doc_id"), F.least("doc_id", "other").alias("other")).distinct()


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """doc_id and the shingle set, as bytes, of the rows of ``docs`` whose id may be among ``wanted`` (key)."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        return {"doc_id": rows["doc_id"], "shingles": [shingle_set(t, width).tobytes() for t in rows["text"].to_pylist()]}

    asked = possible(docs.where("doc_id is not null").select("doc_id", whole().alias("text")), F.col("doc_id"), wanted)
    return batches(asked.where("maybe").select("doc_id", "text"), run, "doc_id long, shingles binary")


def alike(left: bytes, right: bytes, similarity: float) -> bool:
    a, b = np.frombuffer(left, dtype=np.uint32), np.frombuffer(right, dtype=np.uint32)
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) or not len(a):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common)


def compared(docs: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links u, v: those of ``pairs`` (doc_id, other) whose texts are alike."""
    sets = stored(shingle_sets(docs, pairs.select(F.explode(F.array("doc_id", "other")).alias("key")), width), "shingle-sets")
    both = (
        pairs.join(sets.select(F.col("doc_id").alias("other"), F.col("shingles").alias("others")), "other")
        .join(sets, "doc_id").select("doc_id", "other", "shingles", "others")
    )

    def compare(rows: dict[str, list]) -> dict[str, list]:
        good = [alike(a, b, similarity) for a, b in zip(rows["shingles"].to_pylist(), rows["others"].to_pylist(), strict=True)]
        u, v = (rows[c].to_numpy()[good] for c in ("doc_id", "other"))
        return {"u": u, "v": v}

    return batches(both, compare, "u long, v long")


def open_cells(known: DataFrame, joined: DataFrame) -> DataFrame:
    """Texts of bands that the first pass leaves open, once for each cell: band, apart, i, j, doc_id, root, rest.

    ``joined`` (node, root) has the groups so far. ``rest`` marks texts outside the largest
    group of the band. Part i of the rest meets part j of the largest group, and itself, in
    cell i, j; ``apart`` marks the cells of two different parts of the rest.
    """
    named = known.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    flat = named.select("doc_id", F.coalesce("root", "doc_id").alias("root"), F.explode("bands").alias("band")).distinct()
    bands_left = stored(
        flat.groupBy("band", "root").count().groupBy("band")
        .agg(F.sum("count").alias("n"), F.max("count").alias("most"), F.max_by("root", F.struct("count", "root")).alias("main"))
        .where("n > 3 and n > most")
        .select("band", "main", F.ceil(F.col("most") / PART).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("most")) / PART).cast("int").alias("rests")),
        "open-bands")
    member = flat.join(bands_left, "band").withColumn("rest", F.col("root") != F.col("main"))
    parts = F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))
    member = member.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))

    def cell(apart, i, j):
        return F.struct(F.lit(apart).alias("apart"), i.alias("i"), j.alias("j"))

    part, rests = F.col("part"), F.sequence(F.lit(0), F.col("rests") - 1)
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: cell(False, part, j))
    with_rest = F.transform(F.filter(rests, lambda k: k != part), lambda k: cell(True, F.least(part, k), F.greatest(part, k)))
    of_main = F.transform(rests, lambda i: cell(False, i, part))
    return member.select("band", "doc_id", "root", "rest", F.inline(F.when(F.col("rest"), F.concat(with_main, with_rest)).otherwise(of_main)))


def cell_links(ids: np.ndarray, roots: np.ndarray, rest: np.ndarray, sets: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Links that join the groups of one cell: each text of the rest with all others, but for what is joined already."""
    arrays = [np.frombuffer(s, dtype=np.uint32) for s in sets]
    sizes = np.array([len(a) for a in arrays])
    values, flat = np.unique(np.concatenate(arrays), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    labels = np.unique(roots, return_inverse=True)[1]
    mark = np.zeros(len(values), dtype=np.uint8)
    links = []
    for i in np.flatnonzero(rest).tolist():
        own = flat[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat], starts, dtype=np.int64)
        mark[own] = 0
        for j in np.flatnonzero((common >= similarity * (sizes[i] + sizes - common)) & (labels != labels[i])).tolist():
            if labels[j] != labels[i]:
                links.append((int(ids[i]), int(ids[j])))
                labels[labels == labels[j]] = labels[i]
        if (labels == labels[0]).all():
            break
    return links


def open_links(docs: DataFrame, known: DataFrame, joined: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links u, v that join the groups ``joined`` (node, root) further, from bands that the first pass leaves open."""
    rows = stored(open_cells(known, joined), "open-cells")
    sets = stored(shingle_sets(docs, rows.select(F.col("doc_id").alias("key")), width).where("length(shingles) > 0"), "open-sets")

    def run(cell: pa.Table) -> pa.Table:
        columns = (cell.column(c).to_numpy() for c in ("doc_id", "root", "rest"))
        links = cell_links(*columns, cell.column("shingles").to_pylist(), similarity)
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    return rows.join(sets, "doc_id").groupBy("band", "apart", "i", "j").applyInArrow(run, "u long, v long")


def copies(docs: DataFrame, links: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Ids (doc_id) of the texts of ``docs`` that are joined with one of a smaller id, by itself or over others.

    ``docs`` has doc_id and text. Texts are joined when they are alike, and by ``links``
    (u, v), which come from elsewhere; groups form over both kinds. Likeness is the share
    of common shingles among all of both texts. Missing and empty texts, and rows without
    a doc_id, are like nothing; rows that share a doc_id count as one text.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    known = stored(banded(docs, width), "bands")
    classes = stored(known.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "set-classes")
    equal = known.join(classes.select("same", F.col("doc_id").alias("v")), "same").where("doc_id <> v").select(F.col("doc_id").alias("u"), "v")
    near = compared(docs, stored(candidates(classes), "candidates"), width, similarity)
    joined = connected(links.union(equal).union(near), "similar-texts")
    more = stored(open_links(docs, classes, joined, width, similarity), "open-links")
    if not more.isEmpty():
        joined = connected(joined.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more), "similar-texts")
    return joined.where("node <> root").select(F.col("node").alias("doc_id")).distinct()
