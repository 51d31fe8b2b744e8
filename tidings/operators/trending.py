"""Recency-weighted trending of clusters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.functions import dates, scores

# Articles shown per trending cluster.
TOP_ARTICLES = 3


def reference_frame(articles: DataFrame, reference: str | datetime | None = "auto") -> DataFrame:
    """One row holding the "now" the recency windows count back from.

    ``auto`` is the latest date in the data; a date text or datetime is taken as it is (an
    unreadable text falls back to ``auto``); ``now`` and the empty text are the wall clock, which
    also stands in when no article has a date.
    """
    clock = F.current_timestamp().cast("timestamp_ntz")
    latest = articles.agg(F.max("published").alias("_latest"))
    if reference is None:
        reference = "auto"
    if isinstance(reference, datetime):
        fixed: Column = F.lit(reference).cast("timestamp_ntz")
    elif reference.strip().lower() in ("", "now"):
        fixed = clock
    elif reference.strip().lower() == "auto":
        fixed = F.lit(None).cast("timestamp_ntz")
    else:
        fixed = dates.parse_date(F.lit(reference))
    return latest.select(F.coalesce(fixed, F.col("_latest"), clock).alias("reference"))


def _since(hours: int, upper_bound: bool) -> Column:
    recent = F.col("published") >= F.col("reference") - F.expr(f"INTERVAL {hours} HOURS")
    return recent & (F.col("published") <= F.col("reference")) if upper_bound else recent


def recent_counts(
    members: DataFrame,
    reference: str | datetime | None = "auto",
    key: str = "cluster_id",
    upper_bound: bool = False,
) -> DataFrame:
    """Per cluster: articles of the last 24 h, 48 h and 7 d (cumulative) and all members.

    ``members`` holds ``key`` and ``published``. Undated members count in the total only. Counting
    is partial before the shuffle, so a hot cluster sends one row per map task.
    """
    anchored = members.select(key, "published").crossJoin(
        F.broadcast(reference_frame(members, reference))
    )
    return anchored.groupBy(key).agg(
        F.count_if(_since(24, upper_bound)).alias("count_24h"),
        F.count_if(_since(48, upper_bound)).alias("count_48h"),
        F.count_if(_since(24 * 7, upper_bound)).alias("count_7d"),
        F.count(F.lit(1)).alias("total"),
    )


def with_score(counts: DataFrame) -> DataFrame:
    score = scores.trending_score(
        F.col("count_24h"), F.col("count_48h"), F.col("count_7d"), F.col("total")
    )
    return counts.withColumn("trending_score", scores.rounded_score(score))


def top_recent(
    members: DataFrame, n: int = TOP_ARTICLES, key: str = "cluster_id", id_column: str = "article_id"
) -> DataFrame:
    """The ``n`` most recent articles per cluster, undated last, ties by id.

    The rank filter is applied in the map tasks first, so at most ``n`` rows per cluster and map
    task are shuffled.
    """
    window = W.partitionBy(key).orderBy(F.col("published").desc_nulls_last(), F.col(id_column))
    return members.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def recent_of_cluster(
    members: DataFrame, cluster_id: int | str, n: int = 10, id_column: str = "article_id"
) -> DataFrame:
    """The ``n`` most recent articles of one cluster."""
    return (
        members.filter(F.col("cluster_id") == cluster_id)
        .orderBy(F.col("published").desc_nulls_last(), F.col(id_column))
        .limit(n)
    )


def label_clusters(clusters: DataFrame, topics: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Add the topic label of each cluster, ``Cluster <id>`` where it has none."""
    labels = topics.select(key, F.col("label").alias("_label"))
    return clusters.join(labels, key, "left").select(
        *clusters.columns, scores.cluster_label(F.col("_label"), F.col(key)).alias("label")
    )


def trending(
    members: DataFrame,
    topics: DataFrame,
    reference: str | datetime | None = "auto",
    upper_bound: bool = False,
) -> DataFrame:
    """Ranked clusters: counts, score, label and their most recent articles.

    ``members`` holds ``cluster_id, article_id, title, url, published``; members whose article is
    gone (NULL title and url) count in the total but are not listed.
    """
    ranked = with_score(recent_counts(members, reference, upper_bound=upper_bound))
    known = members.filter("title IS NOT NULL OR url IS NOT NULL")
    top = (
        top_recent(known)
        .groupBy("cluster_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "rank",
                        F.col("article_id").alias("id"),
                        "title",
                        "url",
                        dates.timestamp_text(F.col("published")).alias("date"),
                    )
                )
            ).alias("top_articles")
        )
    )
    return (
        label_clusters(ranked, topics)
        .join(top, "cluster_id", "left")
        .orderBy(F.col("trending_score").desc(), F.col("cluster_id"))
    )


def top_trending(ranked: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` trending clusters; none for ``n <= 0``."""
    return ranked.orderBy(F.col("trending_score").desc(), F.col("cluster_id")).limit(max(n, 0))


def restrict_to_clusters(ranked: DataFrame, visible: DataFrame) -> DataFrame:
    """Trending rows of the visible clusters only."""
    return ranked.join(visible.select("cluster_id"), "cluster_id", "left_semi")


def trending_windows(
    members: DataFrame, key: str = "cluster_id", window_hours: int = 24, slide_hours: int = 1
) -> DataFrame:
    """Articles per cluster in sliding windows.

    Rows are first counted per slide-wide slot; only those counts are spread over the windows they
    belong to, so the fan-out works on slots instead of articles.
    """
    slide, width = f"{slide_hours} hours", window_hours // slide_hours
    slots = (
        members.filter("published IS NOT NULL")
        .groupBy(key, F.window("published", slide).alias("_slot"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(key, F.col("_slot.start").alias("_start"), "_n")
    )
    step = F.expr(f"INTERVAL {slide_hours} HOURS")
    spread = slots.select(
        key, "_n", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_back"), "_start"
    ).select(key, "_n", (F.col("_start") - F.col("_back") * step).alias("window_start"))
    return spread.groupBy(key, "window_start").agg(F.sum("_n").alias("article_count"))
