"""Trending score, bands, scaling and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the three cumulative recency windows.
WEIGHT_24H, WEIGHT_48H, WEIGHT_7D = 3.0, 1.5, 0.5
# Display bands and font range.
SCORE_BANDS = ((0.7, "high"), (0.5, "medium"))
SIMILARITY_BANDS = ((0.95, "high"), (0.92, "medium"))
FONT_MIN, FONT_MAX = 13, 30
LABEL_KEYWORDS = 3
NO_LABEL = "unlabeled cluster"


def trending_score(count_24h: Column, count_48h: Column, count_7d: Column, total: Column) -> Column:
    raw = count_24h * WEIGHT_24H + count_48h * WEIGHT_48H + count_7d * WEIGHT_7D
    return F.when(total > 0, raw / total).otherwise(F.lit(0.0))


def rounded_score(score: Column, digits: int = 4) -> Column:
    return F.bround(score, digits)


def score_band(score: Column) -> Column:
    (high, high_name), (medium, medium_name) = SCORE_BANDS
    return F.when(score > high, high_name).when(score > medium, medium_name).otherwise("low")


def similarity_band(similarity: Column) -> Column:
    (high, high_name), (medium, medium_name) = SIMILARITY_BANDS
    return (
        F.when(similarity >= high, high_name).when(similarity >= medium, medium_name).otherwise("low")
    )


def font_size(score: Column, low: Column, high: Column) -> Column:
    """Whole font size by min-max scaling; the middle of the range when all scores are equal."""
    ratio = (score - low) / F.nullif(high - low, F.lit(0.0))
    scaled = F.floor(F.lit(float(FONT_MIN)) + ratio * (FONT_MAX - FONT_MIN)).cast("int")
    return F.when(high <= low, F.lit((FONT_MIN + FONT_MAX) // 2)).otherwise(scaled)


def topic_label(keywords: Column) -> Column:
    joined = F.array_join(F.slice(keywords, 1, LABEL_KEYWORDS), ", ")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(NO_LABEL))


def cluster_label(label: Column, cluster_id: Column) -> Column:
    """Topic label of a cluster, or ``Cluster <id>`` where it has none."""
    named = F.nullif(F.trim(label), F.lit(""))
    return F.coalesce(named, F.concat(F.lit("Cluster "), cluster_id.cast("string")))
