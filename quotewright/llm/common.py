"""What the corpus operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from quotewright.session import prepare
from quotewright.sources import scratch

#: Order value of a missing id: it comes after every other one.
LAST_ID = 2**63 - 1
#: Rows and bytes of a batch that goes to a Python worker; bounds its memory.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}
#: Slots of the fixed-size filter that ``possible`` broadcasts: 2^20 words of 64 bits.
FILTER_WORDS = 1 << 20


def session(spark: SparkSession) -> SparkSession:
    """Apply the settings of the library and of this package."""
    prepare(spark)
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write to the shared folder and read back: computed once, and safe when executors are lost."""
    path = scratch.fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(text: str = "text") -> Column:
    """The text as string; a missing one is empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def order_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def shown_id(column: str) -> Column:
    """The id that ``order_id`` was made from."""
    return F.when(F.col(column) != LAST_ID, F.col(column))


def batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, Any]], schema: str | StructType) -> DataFrame:
    """Arrow batches through ``fn``, which gets and returns columns by name."""
    arrow, owner = arrow_schema(schema), fn.__module__

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(owner)
        for batch in stream:
            if batch.num_rows:
                out = fn({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
                result = pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in arrow], schema=arrow)
                del batch, out  # while the next one comes, only the result is held
                yield result
                del result
        # a worker lives on; what its task no longer needs goes back to the system
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def _array(values: Any, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def arrow_schema(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def with_rows(docs: DataFrame) -> tuple[DataFrame, Callable[[dict[str, list]], list[str]]]:
    """Whole rows as the column ``row``, and what reads their texts in a batch.

    The texts are read out of the rows, so a batch holds them once.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    if isinstance(docs.schema["text"].dataType, StringType):
        return docs.select(row), lambda rows: [t or "" for t in rows["row"].field("text").to_pylist()]
    return docs.select(row, whole().alias("text")), lambda rows: rows["text"].to_pylist()


def let_go(owner: str) -> None:
    """Drop the values that a worker has kept for another module than ``owner``, before a task of it begins."""
    if sys.__dict__.get("_corpus_worker_owner") != owner:
        sys.__dict__.setdefault("_corpus_worker_values", {}).clear()
        sys.__dict__["_corpus_worker_owner"] = owner


def worker_value(name: str, make: Callable[[], Any]) -> Any:
    """A value made once per Python worker and kept for its later tasks, such as a loaded tokenizer.

    Workers serve one stage after the other, so what another operator has left is let go,
    here and by ``let_go`` where the next operator keeps nothing itself.
    """
    store = sys.__dict__.setdefault("_corpus_worker_values", {})
    if name not in store:
        store.clear()
        store[name] = make()
    return store[name]


class Memo(dict):
    """Results by key in a worker; emptied when it has ``most`` entries. Keys over ``longest`` are not kept."""

    def __init__(self, make: Callable[[str], Any], most: int = 300_000, longest: int = 80):
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key: str) -> Any:
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def possible(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Add ``maybe``: false only where ``key`` is in none of the rows of ``keys`` (column ``key``).

    A hashed bit set of a fixed number of words is broadcast, at most FILTER_WORDS
    rows of two longs, whatever the number of keys. It only saves shuffling rows that
    have no match; with very many keys it lets more of them through.
    """
    slot = F.pmod(F.xxhash64("key"), F.lit(FILTER_WORDS * 64))
    words = (
        keys.select(slot.alias("slot")).groupBy((F.col("slot") / 64).cast("long").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("bits"))
    )
    own = F.pmod(F.xxhash64(key), F.lit(FILTER_WORDS * 64))
    return (
        df.withColumn("own_slot", own).withColumn("word", (F.col("own_slot") / 64).cast("long"))
        .join(F.broadcast(words), "word", "left")
        .withColumn("maybe", F.coalesce(F.getbit("bits", (F.col("own_slot") % 64).cast("int")) == 1, F.lit(False)))
        .drop("word", "bits", "own_slot")
    )


def with_lists(docs: DataFrame, lists: DataFrame, column: str, only: bool = False) -> DataFrame:
    """Add each document's list, missing where it has none; texts without a list are not shuffled for it."""
    flagged = possible(docs, F.struct("did", "text_id"), lists.select(F.struct("did", "text_id").alias("key")))
    kind = lists.schema[column].dataType
    joined = flagged.where("maybe").drop("maybe").join(lists, ["did", "text_id"], "inner" if only else "left")
    if only:
        return joined
    rest = flagged.where("not maybe").drop("maybe").withColumn(column, F.lit(None).cast(kind))
    return joined.unionByName(rest)


def roots(n: int, left: np.ndarray, right: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over undirected edges, by hooking and pointer jumping."""
    labels = np.arange(n) if labels is None else labels
    while True:
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return labels
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels = jumped


def connected(edges: DataFrame, name: str) -> DataFrame:
    """Smallest node reachable from every node of ``edges`` (columns u, v of one ordered type).

    Alternating large-star and small-star steps; each is one grouping on a node with
    map-side minima, and its result is written to the shared folder. Returns node, root.
    """
    pairs = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    while True:
        both = pairs.union(pairs.select("v", "u"))
        # minima are written first, so that the joins read plain shuffles, whose hot keys Spark can split
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, name)
        lowest = stored(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(lowest, "u")
        step = stored(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct(), name)
        # done when every node points at a root and nothing changed
        heads = step.select(F.col("v").alias("u")).distinct()
        if step.join(heads, "u", "left_semi").isEmpty() and step.groupBy("u").count().where("count > 1").isEmpty():
            return step.select(F.col("u").alias("node"), F.col("v").alias("root"))
        pairs = step
