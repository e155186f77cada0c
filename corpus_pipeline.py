"""A cleaning pipeline over ``documents``: every stage calls one corpus operator.

The stages keep all columns of the documents, except that the last one returns where
each piece of every remaining document is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.llm import decontaminate, line_chunks, packing, simhash
from quotewright.llm import toxicity as severity
from quotewright.llm.common import session, stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic. The model is fitted on the labelled ones among all documents."""
    return severity.without_toxic(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated line chunks; one of which nothing is left goes."""
    # documents may have a column of the count's name; it steps aside
    aside = {c: f"_own_{c}" for c in docs.columns if c.lower() == "lines_removed"}
    cut = line_chunks.line_dedup(session_of(spark, docs).withColumnsRenamed(aside))
    kept = cut.where((F.col("lines_removed") == 0) | (F.trim("text") != ""))
    return kept.select([F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: fingerprints within 2 bits, or 0.8 of the five-word shingles."""
    return simhash.keep_first(session_of(spark, docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes."""
    return packing.best_two_fit(session_of(spark, docs))


def session_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    session(spark)
    return docs


STAGES = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("decontamination", decontamination), ("best_fit_packing", best_fit_packing),
]

#: Scores and token ids have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
