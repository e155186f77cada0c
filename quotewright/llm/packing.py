"""Best-two-fit packing of token sequences into bins of a fixed size.

Only lengths matter for packing, and there are at most ``size`` different ones, so the
plan is made on how many pieces there are of each length: bins with the same lengths
are planned once, with a multiplicity. Its size depends on ``size``, not on the corpus.
Pieces are then numbered within their length in parallel and take the places that the
plan has for their length. Nothing but counts reaches the driver.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotewright.llm.common import batches, stored, whole, worker_value

MODEL = "byte_bpe_50k.json"
END_ID = 2
#: Pieces of one length that one task numbers.
RANK_BLOCK = 50_000

#: White space, and two marks that count as such in some libraries only.
BLANK = r"\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: A space that stands next to white space, or at an end of the text. The first is for Arrow.
LOOSE_SPACE = f"[{BLANK}] | [{BLANK}]|^ | $"
LOOSE = re.compile("[\\s᠎﻿] | [\\s᠎﻿]|^ | $")
#: Latin letters; a sign behind one begins a pre-token, and a line break between others than white space is one.
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
SIGN_AFTER_LETTER = f"([{LETTER}])([!-/:-@\\[-`{{-~])"
LINE_BREAK = f"([^{BLANK}])\n([^{BLANK}])"
STEM = f"^ ?[{LETTER}]+$"
#: Stands where a text is cut, while it is.
MARK = "\0"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit integers.

    Texts are cut into words, and runs of many words looked up by their distinct ones.
    ``known`` has the words met lately; when it is full it becomes ``older``, from which
    what is met again comes back.
    """

    #: Words that a generation keeps, and characters of the longest one kept.
    MOST, LONGEST = 100_000, 80
    #: Texts that are cut, and words that are looked up, at once; bounds a worker's memory.
    TEXTS, RUN = 500, 1 << 17

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # byte-level models see every byte as a printable character: itself, or one above 255
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.printable = np.arange(256, dtype="<u4")
        self.printable[hidden] = 256 + np.arange(len(hidden))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def stems(self, stems: list[str]) -> list[bytes]:
        """Ids of runs of letters, perhaps with a leading space: one pre-token each, which the model alone splits."""
        shown = self.printable[np.frombuffer("\n".join(stems).encode(), np.uint8)].tobytes().decode("utf-32-le")
        return [array("I", [t.id for t in self.model.tokenize(s)]).tobytes() for s in shown.split(chr(self.printable[10]))]

    def words(self, words: pa.Array) -> list[bytes]:
        """Ids of each of some distinct words; what no generation has is encoded."""
        if len(self.known) >= self.MOST:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        keys = words.to_numpy(zero_copy_only=False)
        fresh = np.array([k not in known for k in keys], bool)
        plain = pc.match_substring_regex(words, STEM).to_numpy(zero_copy_only=False)
        known.update([(k, older[k]) for k in keys[fresh] if k in older])
        fresh[fresh] = [k not in known for k in keys[fresh]]
        known.update([(k, self.encode(k)) for k in keys[fresh & ~plain]])
        if len(stems := keys[fresh & plain].tolist()):
            known.update(zip(stems, self.stems(stems), strict=True))
        ids = [known[k] for k in keys]
        for long in [k for k in keys[fresh] if len(k) > self.LONGEST]:
            del known[long]
        return ids

    def run(self, words: pa.Array) -> pa.Array:
        """Ids of each word."""
        found = words.dictionary_encode()
        return pa.array(self.words(found.dictionary), pa.large_binary()).take(found.indices)

    def some(self, texts: pa.Array) -> Iterator[bytes]:
        whole = pc.match_substring_regex(texts, LOOSE_SPACE)
        for special in (*self.specials, MARK):
            whole = pc.or_(whole, pc.match_substring(texts, special))
        cut_up = pc.replace_substring(texts.filter(pc.invert(whole)), " ", f"{MARK} ")
        cut_up = pc.replace_substring_regex(cut_up, LINE_BREAK, f"\\1{MARK}\n{MARK}\\2")
        cut_up = pc.split_pattern(pc.replace_substring_regex(cut_up, SIGN_AFTER_LETTER, f"\\1{MARK}\\2"), MARK)
        words, ends = cut_up.flatten(), np.cumsum([0, *pc.list_value_length(cut_up).to_numpy()])
        runs = [self.run(words[i : i + self.RUN]) for i in range(0, len(words), self.RUN)]
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([pa.array([], pa.large_binary()), *runs]))
        joined = iter(pc.binary_join(ids, pa.scalar(b"", pa.large_binary())))
        for text, loose in zip(texts, whole.to_pylist(), strict=True):
            yield self.encode(text.as_py()) if loose else next(joined).as_py()

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of whole texts. The tokenizer never joins what a cut divides: a character and
        the single space after it, a letter and a sign, a line break and what is around it."""
        for i in range(0, len(texts), self.TEXTS):
            yield from self.some(texts[i : i + self.TEXTS])

    def ids(self, text: str) -> bytes:
        return next(self.texts(pa.array([text])))


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than ``size``."""
    first = (n - 1) % size + 1
    return [(0, first), *((s, size) for s in range(first, n, size))]


def token_pieces(docs: DataFrame, path: str | None = None, size: int = 1024, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut where they exceed ``size``."""
    path = path or public_tokenizers.path(MODEL)
    end = int(end_id).to_bytes(4, "little")

    def pieces(rows: dict[str, list]) -> dict[str, list]:
        words = worker_value(f"words {path}", lambda: WordIds(path))
        out: list[tuple] = []
        for doc, ids in zip(rows["doc_id"].to_pylist(), words.texts(rows["text"]), strict=True):
            ids += end
            for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                out.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*out, strict=True), strict=True))

    return batches(docs.select("doc_id", whole().alias("text")), pieces, PIECES)


@dataclass(frozen=True)
class Plan:
    """Places by length: entry i has ``room`` places for its length in each of its bins."""

    key: np.ndarray  # length << 40 | first rank that goes to the entry, ascending
    base: np.ndarray
    room: np.ndarray
    first_bin: np.ndarray
    offset_at: np.ndarray  # where the entry's offsets begin in ``offsets``
    offsets: np.ndarray
    bins: int


def _largest(counts: np.ndarray) -> np.ndarray:
    """For each x, the largest length up to x that is left (0: none)."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def fill(counts: np.ndarray, size: int) -> list[int]:
    """Lengths of the next bin, by best-two-fit over what is left."""
    left, gap, bin_ = counts.copy(), size, []
    largest = _largest(left)
    while gap and (x := int(largest[gap])):
        bin_.append(x)
        gap -= x
        left[x] -= 1
        if not left[x]:
            largest = _largest(left)
    if gap and len(bin_) > 1 or gap and bin_:
        smallest = min(bin_)
        room, best = gap + smallest, (smallest, 0, 0)
        for a in np.flatnonzero(left[: room + 1])[::-1]:
            if 2 * a <= best[0]:
                break
            b = min(room - int(a), int(a))
            b = int(largest[b])
            if b == a and left[a] < 2:
                b = int(largest[b - 1])
            if b and a + b > best[0]:
                best = (int(a) + b, int(a), b)
            if best[0] == room:
                break
        if best[1]:
            bin_.remove(smallest)
            bin_ += best[1:]
    return sorted(bin_, reverse=True)


def plan_bins(counts: dict[int, int], size: int) -> Plan:
    """Pack ``counts`` pieces by length into bins of ``size``."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(size + 1, dtype=np.int64)
    entries, offsets, bins = [], [], 0
    while left.any():
        lengths = fill(left, size)
        values, need = np.unique(lengths, return_counts=True)
        times = int((left[values] // need).min())
        ends = np.cumsum(lengths)
        for x, k in zip(values.tolist(), need.tolist(), strict=True):
            entries.append((x, int(used[x]), k, bins, len(offsets)))
            offsets += [int(e) - x for e, y in zip(ends, lengths, strict=True) if y == x]
        left[values] -= need * times
        used[values] += need * times
        bins += times
    entries.sort()
    x, base, room, first, at = np.array(entries, dtype=np.int64).reshape(-1, 5).T
    return Plan((x << 40) | base, base, room, first, at, np.array(offsets, dtype=np.int64), bins)


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (PIECES).

    Repeated rows are pieces of their own; an empty table gives an empty result.
    """
    pieces = stored(pieces, "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    plan = plan_bins(counts, size)
    # as many blocks as tasks at least, so that a common length is numbered by all of them
    blocks = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(counts.values()) // RANK_BLOCK)
    columns = pieces.columns
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int"))
    before = (
        dealt.groupBy("length", "block").count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("block")) - F.col("count"))
        .drop("count")
    )
    ranked = (
        dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "block").orderBy(*columns)))
        .join(before, ["length", "block"])
        .select(*columns, (F.col("rank") - 1 + F.col("before")).alias("rank"))
    )

    def place(rows: dict[str, list]) -> dict[str, list]:
        length, rank = (rows[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
        i = np.searchsorted(plan.key, (length << 40) | rank, side="right") - 1
        nth = rank - plan.base[i]
        return {c: rows[c] for c in columns} | {
            "sequence_id": plan.first_bin[i] + nth // plan.room[i],
            "offset": plan.offsets[plan.offset_at[i] + nth % plan.room[i]],
        }

    return batches(ranked, place, f"{PIECES}, sequence_id long, offset long")


def best_two_fit(docs: DataFrame, path: str | None = None, size: int = 1024, end_id: int = END_ID) -> DataFrame:
    """Where every piece of every document goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``docs`` has doc_id and text; a missing text is empty and has only the end id.
    Repeated documents are packed as often as they occur.
    """
    return pack(token_pieces(docs, path, size, end_id), size)
