"""Quality / importance look-ups and the mean quality of linked articles."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quality classes ranked for the link average, and the label of
# each rounded rank (7 also reads as Featured).
QUALITY_RANK = {"fa": 6, "a": 5, "ga": 4, "b": 3, "c": 2, "start": 1, "stub": 0}
RANK_LABEL = {7: "Featured", 6: "Featured", 5: "A-Class", 4: "Good", 3: "B", 2: "C", 1: "Start", 0: "Stub"}

# Accepted quality and importance codes.
QUALITY_CODES = ["fa", "a", "ga", "bplus", "b", "c", "start", "stub", "fl", "list", "unknown"]
IMPORTANCE_LEVELS = ["low", "mid", "high", "top"]


def _lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def quality_rank(col: Column) -> Column:
    """Rank of a quality code (case-insensitive); NULL for codes without a rank."""
    return F.element_at(_lit_map(QUALITY_RANK), F.lower(F.trim(col)))


def rank_label(col: Column) -> Column:
    return F.element_at(_lit_map(RANK_LABEL), col)


def source_quality(links: DataFrame, quality: DataFrame, *, id_col: str = "id",
                   link_col: str = "link_id") -> DataFrame:
    """Mean quality of the articles an article links to.

    ``links(id, link_id)`` with duplicates counting twice, ``quality(id,
    quality)``.  Only ranked qualities count; an article without a ranked link
    is dropped.  The mean is rounded half up to a rank and labelled.

    Plan: the quality side becomes ``(link_id, rank)`` (unranked rows filtered
    before the join), one shuffle join on ``link_id`` then a partial+final
    aggregate on ``id`` -- the map-side partial aggregate absorbs an article
    with a huge link list; AQE splits a hub ``link_id``.
    """
    ranked = (quality
              .select(F.col("id").alias(link_col), quality_rank(F.col("quality")).alias("_r"))
              .where(F.col("_r").isNotNull()))
    agg = (links.select(id_col, link_col)
           .join(ranked, link_col, "inner")
           .groupBy(id_col)
           .agg(F.sum("_r").alias("_s"), F.count(F.lit(1)).alias("n_rated")))
    mean = F.col("_s").cast("double") / F.col("n_rated")
    return agg.select(
        id_col,
        rank_label(F.floor(mean + F.lit(0.5)).cast("int")).alias("source_quality"),
        F.round(mean, 6).alias("mean_rank"),
        "n_rated")


def lookup_quality(articles: DataFrame, quality: DataFrame, id_col: str = "id") -> DataFrame:
    """Left join the quality code (lower-cased); NULL when the article has none."""
    q = quality.select(F.col("id").alias(id_col), F.lower(F.col("quality")).alias("quality"))
    return articles.join(q, id_col, "left")


def quality_importance(quality: DataFrame, importance: DataFrame) -> DataFrame:
    """(id, quality, importance) for ids present in both tables."""
    return quality.select("id", "quality").join(importance.select("id", "importance"), "id", "inner")
