"""Token counts by a two-tier lookup of pre-token lengths on the map side.

The piece tokenizer never joins characters across the gap between a word and the
space after it: no piece of its vocabulary holds a space marker behind another
character. So a text falls apart into pre-tokens, each with its leading spaces, whose
token counts add up exactly. Tier one is a broadcast hash table with the counts of the
vocabulary's own words, the frequent pre-tokens; it has at most one entry per
vocabulary piece. Tier two is a bounded memo in every Python worker, which encodes what
tier one lacks. No pre-token is ever shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from quotewright.llm.common import Memo, batches, whole, worker_value

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: A space after something that is not a space: a pre-token ends before it.
GAP = re.compile("(?<=[^ ]) ")


def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def frequent_lengths(path: str) -> dict[str, int]:
    """Counts of the words that the vocabulary holds, by pre-token without its first space."""
    sp = processor(path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    words = [p[1:] for p in pieces if len(p) > 1 and p[0] == MARK and MARK not in p[1:]]
    return dict(zip(words, map(len, sp.encode(words, num_threads=1)), strict=True))


class Lengths(Memo):
    """Token count of a pre-token: from the table, else from the memo, else encoded."""

    def __init__(self, table: dict[str, int], path: str):
        self.table, self.sp = table, processor(path)
        super().__init__(lambda key: len(self.sp.encode(key)) if key else 1)

    def __missing__(self, key: str) -> int:
        known = self.table.get(key)
        return super().__missing__(key) if known is None else known


def count_tokens(text: str, lengths: dict[str, int]) -> int:
    if not text:
        return 0
    text = text.replace(MARK, " ")
    if "  " in text or text[0] == " ":
        parts = GAP.split(text)
    else:
        parts = text.split(" ")
    return sum(map(lengths.__getitem__, parts))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` (doc_id, text).

    A missing or empty text has no bytes and no tokens. Repeated rows and missing ids
    each give a row of their own. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path(MODEL)
    table = spark.sparkContext.broadcast(frequent_lengths(path))

    def count(rows: dict[str, list]) -> dict[str, list]:
        lengths = worker_value(f"lengths {path}", lambda: Lengths(table.value, path))
        texts = rows["text"].to_pylist()
        counts = [count_tokens(t, lengths) for t in texts]
        return {
            "doc_id": rows["doc_id"], "n_bytes": [len(t.encode()) for t in texts],
            "n_tokens": counts, "over_limit": [n > limit for n in counts],
        }

    rows = docs.select("doc_id", whole().alias("text"))
    return batches(rows, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
