"""Summary views on clusters, duplicates and the corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.functions import scores, text
from tidings.functions.publishers import DEFAULT_PUBLISHERS, Publisher
from tidings.operators.articles import filter_sources
from tidings.operators.trending import label_clusters

# Bars shown in the two charts.
TOP_BY_SIZE, TOP_BY_TREND = 15, 10
# Ids per membership row; a cluster of any size becomes as many rows as it needs.
MEMBERS_PER_ROW = 1000

_ARTICLE_FIELDS = ("title", "url", "date", "domain")


def cluster_points(clusters: DataFrame, points: DataFrame, articles: DataFrame) -> DataFrame:
    """Members with coordinates and article fields; members without coordinates are left out."""
    blank = [F.coalesce(name, F.lit("")).alias(name) for name in _ARTICLE_FIELDS]
    return (
        clusters.select("article_id", "cluster_id")
        .join(points.select("article_id", "x", "y"), "article_id")
        .join(articles.select("article_id", *_ARTICLE_FIELDS), "article_id", "left")
        .select("article_id", "cluster_id", "x", "y", *blank)
    )


def cluster_sizes(
    clusters: DataFrame,
    articles: DataFrame | None = None,
    slugs: Sequence[str] | None = None,
    configured: Sequence[Publisher] = DEFAULT_PUBLISHERS,
) -> DataFrame:
    """Members per cluster; with a source selection only its articles, empty clusters vanish."""
    members = clusters
    if slugs:
        if articles is None:
            raise ValueError("a source selection needs the articles")
        allowed = filter_sources(articles, slugs, configured).select("article_id")
        members = clusters.join(allowed, "article_id", "left_semi")
    return members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("article_count"))


def cluster_membership(
    clusters: DataFrame, k: int | None = None, per_row: int = MEMBERS_PER_ROW
) -> DataFrame:
    """Ids per cluster in ascending order, cut into rows of bounded length.

    ``cluster_id, part, article_ids``: parts follow the id ranges, so the parts of a cluster laid
    end to end are its sorted member list. With ``k`` clusters without members keep an empty row.
    """
    part = F.floor(F.col("article_id") / F.lit(per_row)).cast("bigint")
    lists = clusters.groupBy("cluster_id", part.alias("part")).agg(
        F.sort_array(F.collect_list("article_id")).alias("article_ids")
    )
    if k is None:
        return lists
    every = clusters.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    return every.join(lists, "cluster_id", "left").select(
        "cluster_id",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("article_ids", F.array().cast("array<bigint>")).alias("article_ids"),
    )


def cluster_summaries(
    clusters: DataFrame,
    topics: DataFrame,
    articles: DataFrame | None = None,
    slugs: Sequence[str] | None = None,
    configured: Sequence[Publisher] = DEFAULT_PUBLISHERS,
) -> DataFrame:
    """Label, keywords and article count per cluster; the points are ``cluster_points``."""
    sizes = cluster_sizes(clusters, articles, slugs, configured)
    keywords = topics.select("cluster_id", F.col("keywords").alias("_keywords"))
    none = F.array().cast("array<string>")
    return (
        label_clusters(sizes, topics)
        .join(keywords, "cluster_id", "left")
        .select("cluster_id", "label", F.coalesce("_keywords", none).alias("keywords"), "article_count")
    )


def cluster_articles(
    clusters: DataFrame, articles: DataFrame, cluster_id: int, points: DataFrame | None = None
) -> DataFrame:
    """Articles of one cluster with coordinates where known; an unknown cluster raises KeyError."""
    members = clusters.filter(F.col("cluster_id") == cluster_id).select("article_id", "cluster_id")
    if not members.head(1):
        raise KeyError(f"unknown cluster_id: {cluster_id}")
    joined = members.join(articles.select("article_id", *_ARTICLE_FIELDS), "article_id")
    blank = [F.coalesce(name, F.lit("")).alias(name) for name in _ARTICLE_FIELDS]
    if points is None:
        return joined.select("article_id", "cluster_id", *blank)
    located = joined.join(points.select("article_id", "x", "y"), "article_id", "left")
    return located.select("article_id", "cluster_id", *blank, "x", "y")


def cluster_scatter(points: DataFrame, topics: DataFrame) -> DataFrame:
    """Flat frame for a scatter plot: coordinates, cluster, label and article fields."""
    return label_clusters(points, topics).select(
        "article_id", "x", "y", "cluster_id", "label",
        text.display(F.col("title"), "Untitled").alias("title"),
        text.display(F.col("domain"), "unknown").alias("domain"),
        text.display(F.col("date"), "—").alias("date"),
    )


def top_clusters_by_size(summaries: DataFrame, n: int = TOP_BY_SIZE) -> DataFrame:
    return summaries.orderBy(F.col("article_count").desc(), "cluster_id").limit(n)


def top_clusters_by_trend(ranked: DataFrame, n: int = TOP_BY_TREND) -> DataFrame:
    return ranked.orderBy(F.col("trending_score").desc(), "cluster_id").limit(n)


def trending_now(ranked: DataFrame, summaries: DataFrame, n: int = 5) -> DataFrame:
    """The first trending clusters with their article counts and place."""
    top = ranked.orderBy(F.col("trending_score").desc(), "cluster_id").limit(max(n, 0))
    counts = summaries.select("cluster_id", F.col("article_count").alias("_count"))
    return top.join(counts, "cluster_id", "left").select(
        "cluster_id", "label", "trending_score",
        F.coalesce(F.col("_count").cast("string"), F.lit("—")).alias("article_count"),
    )


def with_font_sizes(ranked: DataFrame, score: str = "trending_score") -> DataFrame:
    """Scale a score over all rows to font sizes; the range is one small broadcast row."""
    bounds = ranked.agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    size = scores.font_size(F.col(score), F.col("_low"), F.col("_high"))
    return ranked.crossJoin(F.broadcast(bounds)).select(*ranked.columns, size.alias("font_size"))


def enrich_pairs(pairs: DataFrame, articles: DataFrame) -> DataFrame:
    """Pairs with title, url, domain and date of both articles.

    A non-blank value already on the pair wins over the article table.
    """

    def side(df: DataFrame, prefix: str) -> DataFrame:
        meta = articles.select(
            F.col("article_id").alias(f"{prefix}_id"),
            *[F.col(name).alias(f"_{name}") for name in _ARTICLE_FIELDS],
        )
        defaults = {"title": "Untitled", "url": "", "domain": "unknown", "date": "—"}
        joined = df.join(meta, f"{prefix}_id", "left")
        for name, default in defaults.items():
            column = f"{prefix}_{name}"
            own = F.nullif(F.col(column), F.lit("")) if column in df.columns else F.lit(None)
            value = text.display(F.coalesce(own, F.col(f"_{name}")), default)
            joined = joined.withColumn(column, value)
        return joined.drop(*[f"_{name}" for name in _ARTICLE_FIELDS])

    return side(side(pairs, "a"), "b")


def duplicate_export(enriched: DataFrame) -> DataFrame:
    """Eleven flat columns, ready for a CSV file."""
    fields = ("id", "title", "url", "domain", "date")
    return enriched.select(
        "similarity",
        *[
            F.col(f"{side}_{name}").alias(f"article_{side}_{name}")
            for side in ("a", "b")
            for name in fields
        ],
    )


def corpus_kpis(articles: DataFrame, clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: articles, clusters, duplicate pairs and pairs per hundred articles."""
    total = articles.agg(F.count(F.lit(1)).alias("articles"))
    groups = clusters.agg(F.countDistinct("cluster_id").alias("clusters"))
    doubles = pairs.agg(F.count(F.lit(1)).alias("duplicate_pairs"))
    share = F.when(
        F.col("articles") > 0, F.round(F.col("duplicate_pairs") / F.col("articles") * 100, 1)
    ).otherwise(F.lit(0.0))
    return total.crossJoin(groups).crossJoin(doubles).withColumn("duplicate_pct", share)
