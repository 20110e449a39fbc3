"""Document-level relevance, quality and recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_JACCARD = 0.30
#: Bounds of the recommendation.
MEDIUM_QUALITY, PRIMARY, SUPPORTING = 0.55, 0.75, 0.50


def relevance(score: Column, matched: Column) -> Column:
    """An aggregate: the best matched score, else half the best score, else 0."""
    return F.coalesce(F.max(F.when(matched, score)), F.max(score) * 0.5, F.lit(0.0))


def recommendation(relevance: Column, quality: Column) -> Column:
    good = quality >= MEDIUM_QUALITY
    return F.when(good & (relevance >= PRIMARY), "primary").when(good & (relevance >= SUPPORTING), "supporting").otherwise("background")


def latest(history: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The current row of each key: the first in ``order``."""
    return history.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_place = 1").drop("_place")


def mean_of(*parts: Column) -> Column:
    """Mean of the values that are not null; null if none is."""
    n = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts), F.lit(0.0)) / n)
