"""Alignment of the tokens of two tokenizers, by divide and conquer at shared cuts.

Both tokenizers cut the same bytes. A byte offset where tokens of both end is a shared
cut. An interval is divided at the shared cut nearest to its middle, which bisecting one
list of ends for the ends of the other finds, and both halves are treated alike; an
interval without a cut is a leaf, a group of tokens that belong together. Some cuts are
known beforehand: before the space of a word and, where no piece holds both, between
letters and other signs. A text is first divided there, and equal intervals are one
problem, solved once per worker and kept in a bounded memo. A text that does not fall
apart like that is one interval.

Corpus counts: in how many documents an id pair is linked. Tasks sum the pairs of many
documents before they are shuffled. A table of fixed size with the most frequent pairs is
broadcast and resolves most links in place; documents' links to other pairs are joined with
the counts, so all links have exact counts however many pairs there are.

Inputs: a missing or empty text, and one whose bytes a tokenizer does not give back, has no
tokens: zeros and an empty digest. Repeated rows and missing or repeated ids are documents of
their own, also in the counts. No rows give no rows. Very long texts are encoded as a whole; a
worker then holds its tokens. Other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotewright.llm.common import arrow_schema, batches, stored, whole, worker_value
from quotewright.llm.packing import LOOSE

BYTE_MODEL, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
MARK = "▁"
#: Most entries of the broadcast table of frequent pairs: 17 bytes each.
FREQUENT = 1 << 18
#: Pairs of which a task holds counts before it passes them on.
HELD = 1 << 20
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<int>"
RESOLVED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<struct<code:long,times:int>>"


def leaves(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Where each leaf ends: how many tokens of a and of b lie before its cut, ascending.

    ``a`` and ``b`` are ascending ends with the same last one. The cut nearest to the middle
    token of an interval divides it; offsets between it and the middle, and as many on
    the other side, are known not to be cuts and are not searched again.
    """
    found = [(len(a), len(b))]
    if len(a) == 1 or len(b) == 1:
        return found
    todo = [(0, len(a) - 1, 0, len(b) - 1)]  # tokens of a whose ends may be cuts, and the span of b they can be in
    while todo:
        low, high, b_low, b_high = todo.pop()
        if low >= high or b_low >= b_high:
            continue
        middle = (low + high) // 2
        for step in range(max(middle - low + 1, high - middle)):
            hit = -1
            for i in (middle + step, middle - step):
                if low <= i < high:
                    j = bisect_left(b, a[i], b_low, b_high)
                    if j < b_high and b[j] == a[i]:
                        hit = i
                        break
            if hit >= 0:
                found.append((hit + 1, j + 1))
                left = hit if hit <= middle else middle - step + 1
                right = hit + 1 if hit >= middle else middle + step
                todo += [(low, left, b_low, j), (right, high, j + 1, b_high)]
                break
    found.sort()
    return found


def groups_and_links(a_ids: list[int], a_ends: list[int], b_ids: list[int], b_ends: list[int], width: int) -> tuple[int, str, list[int]]:
    """Number of groups, their text form, and the code (a * width + b) of every pair of tokens that share bytes."""
    i = j = 0
    texts, codes = [], []
    for a_to, b_to in leaves(a_ends, b_ends):
        texts.append(",".join(map(str, a_ids[i:a_to])) + "|" + ",".join(map(str, b_ids[j:b_to])))
        while i < a_to and j < b_to:
            codes.append(a_ids[i] * width + b_ids[j])
            a_end, b_end = a_ends[i], b_ends[j]
            i, j = i + (a_end <= b_end), j + (b_end <= a_end)
    return len(texts), ";".join(texts), codes


#: Latin letters, and texts of other signs than those and ASCII, of two white-space
#: characters in a row, or of an apostrophe before a letter (a contraction).
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
ODD = re.compile(rf"[^\x00-\x7f{LETTER}]|\s\s|'[{LETTER}]")
#: A run of letters with its leading space, or a run of other signs up to such a space.
RUN = re.compile(rf" ?[{LETTER}]+|(?:(?! [{LETTER}])[^{LETTER}])+")
WORD = re.compile(rf" [{LETTER}]+")
IS_LETTER = re.compile(f"[{LETTER}]")


class Aligner:
    """Per interval that both tokenizers are known to end: (tokens of a, tokens of b, groups, text of the groups, codes).

    None where a tokenizer does not give the bytes back. Intervals with a leading space
    stand alone like that; others follow something else. ``known`` has the intervals met
    lately; when it is full it becomes ``older``, from which what is met again comes back.
    """

    MOST, LONGEST = 200_000, 60

    def __init__(self, byte_path: str, piece_path: str):
        self.a_of = Tokenizer.from_file(byte_path)
        self.a_of.encode_special_tokens = True
        self.b_of = sp = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
        self.printable = {b: 256 + n for n, b in enumerate(hidden)}
        self.space = chr(self.printable[32])
        self.a_model = self.a_of.model
        vocabulary = self.a_of.get_vocab(with_added_tokens=True)
        self.a_bytes = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in vocabulary.items()}
        self.a_size = {i: len(t) for i, t in self.a_bytes.items()}
        self.width = sp.get_piece_size()
        pieces = [sp.id_to_piece(k) for k in range(self.width)]
        plain = [not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k)) for k in range(self.width)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        self.b_text = [p if kept else "" for p, kept in zip(pieces, plain, strict=True)]
        self.b_size = [len(p) for p in self.b_bytes]
        # runs of letters and of other signs can be encoded apart if no piece holds both
        inner = [p.lstrip(MARK) for p, kept in zip(pieces, plain, strict=True) if kept]
        self.by_runs = not any(IS_LETTER.search(p) and re.search(f"[^{LETTER}]", p) for p in inner)
        self.before_sign, self.before_letter = sp.encode("a"), sp.encode(",")
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}
        # hundreds of thousands of kept results would be walked again and again
        gc.freeze()
        gc.set_threshold(100_000, 50, 1_000)

    def solve(self, text: str) -> tuple | None:
        """Encode and align ``text`` as one interval."""
        a = self.a_of.encode(text, add_special_tokens=False).ids
        if text[0] == " ":
            b = self.b_of.encode(text[1:])
        else:
            head, sign = (self.before_letter, ",") if IS_LETTER.match(text) else (self.before_sign, "a")
            b = self.b_of.encode(sign + text)
            if b[: len(head)] != head:
                return None
            b = b[len(head) :]
        a_parts, b_parts = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        want = text.encode()
        if b"".join(a_parts) != want or b"".join(b_parts) != want:
            return None
        return self.linked(a, [*map(len, a_parts)], b, [*map(len, b_parts)])

    def solve_words(self, words: list[str]) -> list[tuple | None]:
        """The same for runs of letters with their space: one pre-token each, which the model alone splits, without loss."""
        out = []
        for text in words:
            b = self.b_of.encode(text[1:])  # one by one: a call for many starts a thread
            if "".join([self.b_text[i] for i in b]) != MARK + text[1:]:
                out.append(self.solve(text))
                continue
            shown = self.space + text[1:] if text.isascii() else text.encode().decode("latin-1").translate(self.printable)
            a = [t.id for t in self.a_model.tokenize(shown)]
            out.append(self.linked(a, [self.a_size[i] for i in a], b, [self.b_size[i] for i in b]))
        return out

    def linked(self, a: list[int], a_sizes: list[int], b: list[int], b_sizes: list[int]) -> tuple:
        n, shown, codes = groups_and_links(a, [*accumulate(a_sizes)], b, [*accumulate(b_sizes)], self.width)
        return len(a), len(b), n, shown, array("q", codes).tobytes()

    def solved(self, runs: list[str]) -> list[tuple | None]:
        """Of each interval of a text; each distinct one is solved once."""
        if len(self.known) >= self.MOST:
            self.known, self.older = {}, self.known
        fresh = set(runs).difference(self.known)
        again = {r for r in fresh if r in self.older}
        self.known.update((r, self.older[r]) for r in again)
        fresh -= again
        words = [r for r in fresh if self.by_runs and WORD.fullmatch(r)]
        self.known.update(zip(words, self.solve_words(words), strict=True))
        self.known.update((r, self.solve(r)) for r in fresh.difference(words))
        found = [self.known[r] for r in runs]
        for long in [r for r in fresh if len(r) > self.LONGEST]:
            del self.known[long]
        return found

    def parts(self, text: str) -> list[tuple]:
        """The solved intervals of a text, in order; none if it has no tokens."""
        if not text:
            return []
        found: list[tuple | None] = [None]
        if not LOOSE.search(text):
            by_runs = self.by_runs and not ODD.search(text)
            found = self.solved(RUN.findall(f" {text}") if by_runs else [f" {word}" for word in text.split(" ")])
        if None in found:
            found = [self.solve(f" {text}")]
        return [] if found == [None] else found

    def document(self, text: str) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, groups_sha256, codes (ascending, distinct) and how often each."""
        parts = self.parts(text)
        if not parts:
            return 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int32)
        n_a, n_b, n, shown, codes = zip(*parts, strict=True)
        every = np.frombuffer(b"".join(codes), np.int64)
        distinct, times = np.unique(every, return_counts=True)
        sha = hashlib.sha256(";".join(shown).encode()).hexdigest()
        return sum(n_a), sum(n_b), sum(n), len(every), sha, distinct, times.astype(np.int32)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrow list array of numpy arrays."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), kind))


def aligned(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """One row per document, numbered, with its sizes, digest, linked pairs as codes, and how often each is linked.

    Written to the shared folder: the texts are encoded once.
    """
    byte_path = byte_path or public_tokenizers.path(BYTE_MODEL)
    piece_path = piece_path or public_tokenizers.path(PIECE_MODEL)

    def run(rows: dict) -> dict:
        aligner = worker_value(f"aligner {byte_path} {piece_path}", lambda: Aligner(byte_path, piece_path))
        n_a, n_b, n, links, sha, codes, times = zip(*map(aligner.document, rows["text"].to_pylist()), strict=True)
        return {"row": rows["row"], "doc_id": rows["doc_id"], "n_a": n_a, "n_b": n_b, "n_groups": n, "n_links": links, "groups_sha256": sha,
                "codes": lists(codes, pa.int64()), "times": lists(times, pa.int32())}

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return stored(batches(numbered, run, ALIGNED), "aligned", compression="zstd")


def pair_width(piece_path: str | None = None) -> int:
    return sentencepiece.SentencePieceProcessor(model_file=piece_path or public_tokenizers.path(PIECE_MODEL)).get_piece_size()


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """code, docs (documents that hold the pair linked) and best (it has the most among the pairs of its a id)."""
    schema = arrow_schema("code long, docs long")

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in stream:
            found = np.concatenate((held, batch.column(0).flatten().to_numpy()))
            weights = np.concatenate((sums, np.ones(len(found) - len(held), np.int64)))
            held, place = np.unique(found, return_inverse=True)
            sums = np.bincount(place, weights, len(held)).astype(np.int64)
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], schema=schema)
                held, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], schema=schema)

    counts = rows.select("codes").mapInArrow(count, "code long, docs long").groupBy("code").agg(F.sum("docs").alias("docs"))
    # a window holds the pairs of one a id: at most as many as the other vocabulary has entries
    mine = Window.partitionBy(F.expr(f"code div {width}"))
    return counts.select("code", "docs", (F.col("docs") == F.max("docs").over(mine)).alias("best"))


def frequent_pairs(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (ascending), counts and best flags of at most ``most`` pairs, the most frequent up to a step of counts."""
    step = F.floor(F.log2("docs") * 8).cast("int")  # a few hundred steps however large the counts are
    sizes = {r["step"]: r["count"] for r in counts.groupBy(step.alias("step")).count().collect()}
    least, total = max(sizes, default=0) + 1, 0
    for s in sorted(sizes, reverse=True):
        total += sizes[s]
        if total > most:
            break
        least = s
    kept = counts.where(step >= least).toArrow().sort_by("code")
    return tuple(kept.column(c).to_numpy() for c in ("code", "docs", "best"))


def resolve(rows: DataFrame, counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The documents of ``rows`` (``aligned``) with n_best and count_sum; ``counts`` from ``pair_counts``, written."""
    table = rows.sparkSession.sparkContext.broadcast(frequent_pairs(counts, most))

    def run(batch: dict) -> dict:
        code, docs, best = table.value
        offsets = batch["codes"].offsets.to_numpy()
        codes, times = batch["codes"].flatten().to_numpy(), batch["times"].flatten().to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        if len(code):
            at = np.minimum(np.searchsorted(code, codes), len(code) - 1)
            hit = code[at] == codes
            sums, bests = np.where(hit, docs[at] * times, 0), np.where(hit & best[at], times, 0)
        else:
            hit, sums, bests = np.zeros(len(codes), bool), np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        total = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[offsets])
        ends = np.concatenate(([0], np.cumsum(~hit)))[offsets].astype(np.int32)
        rest = pa.StructArray.from_arrays([pa.array(codes[~hit]), pa.array(times[~hit], pa.int32())], names=["code", "times"])
        keep = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        return {c: batch[c] for c in keep} | {"n_best": total(bests), "count_sum": total(sums), "rest": pa.ListArray.from_arrays(pa.array(ends), rest)}

    found = stored(batches(rows, run, RESOLVED), "resolved", compression="zstd")
    open_ = F.size("rest") > 0
    links = found.where(open_).select("row", F.explode("rest").alias("link")).select("row", "link.*")
    more = links.join(counts, "code").groupBy("row").agg(
        F.sum(F.col("docs") * F.col("times")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    added = found.where(open_).drop("rest").join(more, "row").withColumns(
        {"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum")})
    return found.where(~open_).select(columns).unionByName(added.select(columns))


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, most: int = FREQUENT) -> DataFrame:
    """How the tokens of every document's text (doc_id, text) in two tokenizers correspond.

    Returns doc_id, n_a, n_b, n_groups, n_links (pairs of tokens that share bytes), n_best
    (links whose pair no other pair of the same a id exceeds in documents), count_sum
    (documents of the pair, summed over links) and groups_sha256.
    """
    rows = aligned(docs, byte_path, piece_path)
    counts = stored(pair_counts(rows, pair_width(piece_path)), "pair-counts")
    return resolve(rows, counts, most)


def aligned_groups(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """doc_id and the groups of every document as arrays of ids; no groups where it has no tokens."""
    byte_path = byte_path or public_tokenizers.path(BYTE_MODEL)
    piece_path = piece_path or public_tokenizers.path(PIECE_MODEL)

    def run(rows: dict) -> dict:
        aligner = worker_value(f"aligner {byte_path} {piece_path}", lambda: Aligner(byte_path, piece_path))
        out = []
        for text in rows["text"].to_pylist():
            shown = [g.split("|") for p in aligner.parts(text) for g in p[3].split(";")]
            out.append([{"a": list(map(int, a.split(","))), "b": list(map(int, b.split(",")))} for a, b in shown])
        return {"doc_id": rows["doc_id"], "groups": out}

    return batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")), run, "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")
