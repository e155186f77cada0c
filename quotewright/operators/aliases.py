"""Industry resolution against a table of aliases of any size.

``functions.industry`` has its few aliases in an expression. Here they are rows: a key is
resolved by an equal canonical name, an equal alias, or the first alias that is in the key or
that the key is in. The containment is a join through shared grams. A text that
contains a pattern contains the pattern's first gram, of up to three characters, so patterns
meet texts on that gram and are then verified. Keys are made distinct before the join.
Keys of up to three characters, the empty one too, are grams themselves: of
each gram only the first alias that has it is kept, so a short key never meets all aliases
it is in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.functions.industry import industry_key

GRAM = 3


def _first_gram(c: Column) -> Column:
    return F.left(c, F.lit(GRAM))


def _grams(c: Column) -> Column:
    """All distinct substrings of one to GRAM characters."""
    def of(n: int) -> Column:
        starts = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(c, i, F.lit(n)))

    return F.array_distinct(F.concat(*[of(n) for n in range(1, GRAM + 1)]))


def first_contained(keys: DataFrame, aliases: DataFrame) -> DataFrame:
    """k and ord of the first alias in or around each key; ``keys`` has distinct k, ``aliases`` ord and alias."""
    rows = aliases.where(F.col("alias") != "").select("ord", "alias")
    in_key = (
        keys.select("k", F.explode(_grams(F.col("k"))).alias("gram"))
        .join(rows.withColumn("gram", _first_gram(F.col("alias"))), "gram")
        .where(F.contains("k", "alias")).groupBy("k").agg(F.min("ord").alias("ord")))
    held = rows.select("ord", "alias", F.explode(F.concat(F.array(F.lit("")), _grams(F.col("alias")))).alias("gram"))
    short = F.length("k") <= GRAM
    by_gram = held.groupBy("gram").agg(F.min("ord").alias("ord"))
    short_keys = keys.where(short).join(by_gram.withColumnRenamed("gram", "k"), "k")
    long_keys = (
        keys.where(~short).withColumn("gram", _first_gram(F.col("k")))
        .join(held.where(F.length("alias") > GRAM), "gram").where(F.contains("alias", "k"))
        .groupBy("k").agg(F.min("ord").alias("ord")))
    return in_key.unionByName(short_keys).unionByName(long_keys).groupBy("k").agg(F.min("ord").alias("ord"))


def resolve_by_table(requests: DataFrame, canonical: DataFrame, aliases: DataFrame, name: str = "resolved") -> DataFrame:
    """Add ``name``: the industry of each request, or NULL.

    ``canonical`` has industry, ``aliases`` has ord (unique), alias and industry. Only
    distinct keys are resolved; requests get the result by their key, where the adaptive
    planner broadcasts few keys and splits a key of very many requests.
    """
    keyed = requests.withColumn("_key", industry_key(F.col("industry")))
    keys = keyed.select(F.col("_key").alias("k")).where("k IS NOT NULL").distinct()
    exact = keys.join(canonical.select(F.col("industry").alias("k")).distinct(), "k").select("k", F.col("k").alias("found"), F.lit(0).alias("rank"))
    named = keys.join(aliases.select(F.col("alias").alias("k"), "ord", "industry"), "k").groupBy("k").agg(
        F.min_by("industry", "ord").alias("found")).select("k", "found", F.lit(1).alias("rank"))
    near = first_contained(keys, aliases).join(aliases.select("ord", "industry"), "ord").select(
        "k", F.col("industry").alias("found"), F.lit(2).alias("rank"))
    best = exact.unionByName(named).unionByName(near).groupBy("k").agg(F.min_by("found", "rank").alias(name))
    return keyed.join(best.withColumnRenamed("k", "_key"), "_key", "left").drop("_key")
