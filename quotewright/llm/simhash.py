"""Near duplicates by SimHash, found with anchor points of a covering code.

Anchors are the words of two copies of the perfect binary Golay code on two blocks of a
fingerprint; the other bits are free. Every block value lies within 3 bits of exactly
one code word, its home, so a pair of homes is the anchor of a fingerprint (covering
radius 3 in each block). A fingerprint at distance d1 and d2 from it in the blocks lies
within 3 + d1 and 3 + d2 of that anchor. So each fingerprint is replicated to all
anchors within the covering radius plus the distance, and compared there with the
fingerprints whose home it is: no linked pair is missed. For up to 2 differing bits the
blocks are bits 0-22 and 23-45. For up to 4, each pair of these and bits 46-63 has
anchors of its own: in one of the pairs the distance is 2 or less.

Equal fingerprints are one class before anything is replicated. An anchor with very
many fingerprints is not compared pairwise: two fingerprints within 2 bits share a
point within 1 bit of both, and such a point has at most 65 of them (for 4 bits: a point
within 2, and 2081).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotewright.llm import similar
from quotewright.llm.common import batches, connected, roots, stored, whole

SEED = 42
RADIUS = 3
#: What a pair of blocks may differ by, and the pairs that cover a threshold.
REACH = 2
PAIRS = {2: ((0, 1),), 4: ((0, 1), (0, 2), (1, 2))}
BLOCK_BITS = 23
CHECK_BITS = 11
#: Generator polynomial of the binary Golay code, a fixed value.
GENERATOR = 0b101011100011
#: Rows at an anchor beyond which its fingerprints go the linear way.
HOT_ANCHOR = 500_000
#: Rows at anchors that a task holds at once, but for those of the last anchor.
HELD_ROWS = 1 << 18
#: Pairs compared at once in a task.
PAIR_BLOCK = 1 << 18


def fingerprint(text: str, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, as unsigned; zero for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(width, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype="<u8")
    set_in = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * set_in > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def remainder(values: np.ndarray) -> np.ndarray:
    """Syndromes: the block values modulo the generator polynomial."""
    values = values.astype(np.int64)
    for bit in range(BLOCK_BITS - 1, CHECK_BITS - 1, -1):
        values = np.where(values >> bit & 1, values ^ (GENERATOR << (bit - CHECK_BITS)), values)
    return values


class Anchors:
    """Error patterns by syndrome: which code words lie within RADIUS + REACH of a block value."""

    def __init__(self) -> None:
        single = 1 << np.arange(BLOCK_BITS, dtype=np.int64)
        levels = [np.zeros(1, dtype=np.int64)]
        for _ in range(RADIUS + REACH):
            grown = levels[-1][:, None] | single
            levels.append(np.unique(grown[levels[-1][:, None] != grown]))
        errors = np.concatenate(levels)
        weight = np.repeat(np.arange(len(levels)), [len(x) for x in levels])
        syndrome = remainder(errors)
        order = np.lexsort((weight, syndrome))
        self.errors, self.extra = errors[order], np.maximum(weight[order] - RADIUS, 0)
        self.start = np.searchsorted(syndrome[order], np.arange((1 << CHECK_BITS) + 1))

    def of_block(self, value: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the code words near a block value, the home first, and their distance beyond RADIUS."""
        s = int(remainder(np.array([value]))[0])
        own = slice(self.start[s], self.start[s + 1])
        return (value ^ self.errors[own]) >> CHECK_BITS, self.extra[own]

    def of(self, fp: int, pairs: tuple[tuple[int, int], ...] = PAIRS[2]) -> list[np.ndarray]:
        """All anchors of a fingerprint for each pair of blocks, its home first."""
        mask, bits, out = (1 << BLOCK_BITS) - 1, BLOCK_BITS - CHECK_BITS, []
        near = [self.of_block(fp >> BLOCK_BITS * i & mask) for i in range(3)]
        for k, (i, j) in enumerate(pairs):
            (a, da), (b, db) = near[i], near[j]
            out.append((k << 2 * bits | a[:, None] << bits | b)[da[:, None] + db <= REACH])
        return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, fp; fp is the fingerprint as a signed long."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        fps = np.array([fingerprint(t, width) for t in rows["text"].to_pylist()], dtype=np.uint64)
        return {"doc_id": rows["doc_id"], "fp": fps.view(np.int64)}

    return batches(docs.select("doc_id", whole().alias("text")), run, "doc_id long, fp long")


def at_anchors(fps: DataFrame, threshold: int) -> DataFrame:
    """Every fingerprint at each of its anchors: anchor, fp, home."""
    anchors, pairs = Anchors(), PAIRS[threshold]

    def run(rows: dict[str, list]) -> dict[str, np.ndarray]:
        values = rows["fp"].to_numpy(zero_copy_only=False)
        near = [x for v in values.view(np.uint64).tolist() for x in anchors.of(v, pairs)]
        values = np.repeat(values, len(pairs))
        counts = np.array([len(x) for x in near])
        home = np.zeros(counts.sum(), dtype=bool)
        home[np.cumsum(counts) - counts] = True
        return {"anchor": np.concatenate(near).astype(np.int32), "fp": np.repeat(values, counts), "home": home}

    return batches(fps.select("fp"), run, "anchor int, fp long, home boolean")


def compare(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints among rows at anchors, as (fingerprint, smallest one it is joined to)."""
    values, code = np.unique(fp, return_inverse=True)
    order = np.argsort(anchor[home], kind="stable")
    homes, home_code = anchor[home][order], code[home][order]
    low = np.searchsorted(homes, anchor, side="left")
    counts = np.searchsorted(homes, anchor, side="right") - low
    at = np.flatnonzero(counts)
    labels = np.arange(len(values))
    step, done = np.cumsum(counts[at]), 0
    while done < len(at):
        upto = max(done + 1, int(np.searchsorted(step, (step[done - 1] if done else 0) + PAIR_BLOCK, side="right")))
        rows = at[done:upto]
        n = counts[rows]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        left, right = np.repeat(code[rows], n), home_code[np.repeat(low[rows], n) + inside]
        apart = np.bitwise_count((values[left] ^ values[right]).view(np.uint64))
        linked = (apart <= threshold) & (left != right)
        labels = roots(len(values), left[linked], right[linked], labels)
        done = upto
    moved = np.flatnonzero(labels != np.arange(len(values)))
    return values[moved], values[labels[moved]]


def whole_anchors(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by anchor, in tables of HELD_ROWS or a little more that cut no anchor."""
    held: list[pa.RecordBatch] = []
    for batch in stream:
        held.append(batch)
        if sum(b.num_rows for b in held) >= HELD_ROWS:
            rows = pa.Table.from_batches(held)
            anchor = rows.column("anchor").to_numpy()
            at = int(np.searchsorted(anchor, anchor[-1]))
            if at:
                yield rows.slice(0, at)
                held = rows.slice(at).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def anchored_links(rows: DataFrame, threshold: int) -> DataFrame:
    """Links (fp, other) that connect what is linked at any anchor; a task holds some anchors at a time."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_anchors(stream):
            u, v = compare(*(part.column(c).to_numpy() for c in ("anchor", "fp", "home")), threshold)
            yield pa.RecordBatch.from_pydict({"fp": pa.array(u, pa.int64()), "other": pa.array(v, pa.int64())})

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "fp long, other long")


def ball_links(fps: DataFrame, threshold: int) -> DataFrame:
    """Links among ``fps`` by common points within half the threshold; connects all within the threshold."""
    ball = F.expr("transform(sequence(-1, 63), i -> if(i < 0, point, point ^ shiftleft(1L, i)))")
    points = fps.select("fp", F.col("fp").alias("point")).distinct()
    for _ in range(threshold // 2):
        points = points.select("fp", F.explode(ball).alias("point")).distinct()
    least = points.groupBy("point").agg(F.min("fp").alias("other"))
    return points.join(least, "point").where("fp <> other").select("fp", "other").distinct()


def similar_classes(classes: DataFrame, threshold: int = 2) -> DataFrame:
    """All links between the distinct fingerprints ``fp`` of ``classes``, as a connecting set (fp, other)."""
    # few small rows become many: deal them out first
    classes = classes.repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    counts = at_anchors(classes, threshold).groupBy("anchor").count().where(F.col("count") > HOT_ANCHOR).select("anchor")
    hot = stored(counts, "hot-anchors")
    placed = at_anchors(classes, threshold)
    links = anchored_links(placed if hot.isEmpty() else placed.join(hot, "anchor", "left_anti"), threshold)
    if not hot.isEmpty():
        links = links.union(ball_links(placed.join(hot, "anchor", "left_semi"), threshold))
    return links


def near_duplicates(docs: DataFrame, width: int = 3, threshold: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text).

    Fingerprints link at ``threshold`` (2 or 4) or fewer differing bits; component_id is the
    smallest doc_id reachable. A missing text is empty; texts without words have
    fingerprint zero and link like any other. Rows without a doc_id link too, but name
    no component; a component of such rows only has none. Repeated rows stay.
    """
    known = stored(fingerprints(docs, width), "fingerprints")
    # a class without any id sorts behind all others and is named by its fingerprint
    classes = stored(
        known.groupBy("fp").agg(F.min("doc_id").alias("first"))
        .select("fp", F.struct(F.col("first").isNull().alias("nameless"), F.coalesce("first", "fp").alias("id")).alias("node")),
        "fingerprint-classes")
    links = stored(similar_classes(classes, threshold), "links")
    named = (
        links.join(classes, "fp").select("other", F.col("node").alias("u"))
        .join(classes.withColumnRenamed("fp", "other"), "other").select("u", F.col("node").alias("v"))
    )
    joined = connected(named, "components")
    component = (
        classes.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
        .select("fp", F.when(~F.col("root.nameless"), F.col("root.id")).alias("component_id"))
    )
    return known.join(component, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, width: int = 5, threshold: int = 2, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest doc_id, with all its columns.

    Texts are near duplicates when their fingerprints link, or when ``similarity`` of
    their shingles are common, see ``similar``; a group forms over both kinds of links.
    Rows that share a doc_id count as one document and stay or go together; rows without
    a doc_id stay.
    """
    found = near_duplicates(docs, width, threshold).where("component_id <> doc_id")
    links = stored(found.select(F.col("doc_id").cast("long").alias("u"), F.col("component_id").alias("v")).distinct(), "linked")
    gone = stored(similar.copies(docs, links, width, similarity), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti")
