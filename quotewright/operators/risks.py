"""Risk labels and the probability by impact matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.functions.text import SPACE_CLASS, ellipsis_label

# Levels, their rank and their colour.
LEVELS = (("High", 3, "#ef4444"), ("Medium", 2, "#f59e0b"), ("Low", 1, "#22c55e"))
DEFAULT_LEVEL = "Medium"
OTHER_COLOUR = "#6366f1"


def normalise_impact(impact: Column) -> Column:
    """High, Medium or Low; anything else, also a missing label, is Medium."""
    label = F.lit(DEFAULT_LEVEL)
    for name, _, _ in LEVELS:
        if name != DEFAULT_LEVEL:
            label = F.when(impact.rlike(f"(?i)^[{SPACE_CLASS}]*{name}[{SPACE_CLASS}]*\\z"), name).otherwise(label)
    return label


def normalise_risk(risks: DataFrame) -> DataFrame:
    """Normalise ``impact``; ``probability`` stays as it was given."""
    return risks.withColumn("impact", normalise_impact(F.col("impact")))


def level_rank(label: Column) -> Column:
    label = F.coalesce(label, F.lit(DEFAULT_LEVEL))
    rank = F.lit(2)
    for name, value, _ in LEVELS:
        rank = F.when(label == name, value).otherwise(rank)
    return rank


def level_colour(label: Column) -> Column:
    label = F.coalesce(label, F.lit(DEFAULT_LEVEL))
    colour = F.lit(OTHER_COLOUR)
    for name, _, value in LEVELS:
        colour = F.when(label == name, value).otherwise(colour)
    return colour


def risk_points(risks: DataFrame) -> DataFrame:
    """Chart position, colour and short label of each risk."""
    return risks.withColumns({
        "x": level_rank(F.col("probability")),
        "y": level_rank(F.col("impact")),
        "colour": level_colour(F.col("impact")),
        "label": ellipsis_label(F.coalesce("risk", F.lit(""))),
    })


def risk_matrix(risks: DataFrame) -> DataFrame:
    """Number of risks in each cell of the matrix."""
    points = risk_points(risks)
    return points.groupBy("x", "y", "colour").agg(F.count("*").alias("risks"))
