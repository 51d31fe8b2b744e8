"""Query facade over a built corpus; every answer is a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.functions.publishers import DEFAULT_PUBLISHERS, Publisher
from tidings.operators import encode, search, similarity, trending, views
from tidings.operators import articles as art
from tidings.operators.search import HITS
from tidings.plans.build import Layout


class Corpus:
    """Search, clusters, trends and duplicates of the tables below one folder."""

    def __init__(
        self, spark: SparkSession, root: str, publishers: Sequence[Publisher] = DEFAULT_PUBLISHERS
    ) -> None:
        self.spark = spark
        self.layout = Layout(root)
        self.publishers = publishers

    def table(self, name: str) -> DataFrame:
        return self.layout.read(self.spark, name)

    @cached_property
    def encoder(self) -> PipelineModel:
        return PipelineModel.load(self.layout.path("encoder"))

    def vector_of_text(self, query: str) -> list[float]:
        one = self.spark.createDataFrame([(query,)], "text STRING")
        return encode.encode_texts(one, self.encoder).head()["embedding"]

    def search(
        self, query: str, k: int = HITS, sources: Sequence[str] | None = None, exact: bool = True
    ) -> DataFrame:
        """Articles closest to a text query, optionally of selected publishers only."""
        articles = self.table("articles")
        hits = search.search_sources(
            self.table("embeddings"), articles, self.vector_of_text(query), sources, k, exact, self.publishers
        )
        return search.describe_hits(hits, articles).orderBy("rank")

    def find_similar(self, article_id: int, k: int = HITS) -> DataFrame:
        """Articles closest to a stored article; an unknown id raises IndexError."""
        hits = search.find_similar(self.table("embeddings"), article_id, k)
        return search.describe_hits(hits, self.table("articles")).orderBy("rank")

    def clusters(self, sources: Sequence[str] | None = None) -> DataFrame:
        """Label, keywords and size per cluster."""
        found = views.cluster_summaries(
            self.table("clusters"), self.table("topics"), self.table("articles"), sources, self.publishers
        )
        return found.orderBy("cluster_id")

    def points(self, sources: Sequence[str] | None = None) -> DataFrame:
        """Clustered articles with coordinates, for the scatter view."""
        clusters = self.table("clusters")
        placed = views.cluster_points(clusters, clusters, self.table("articles"))
        return art.filter_sources(placed, sources, self.publishers)

    def scatter(self, sources: Sequence[str] | None = None) -> DataFrame:
        return views.cluster_scatter(self.points(sources), self.table("topics"))

    def cluster_articles(self, cluster_id: int) -> DataFrame:
        """Articles of one cluster; an unknown cluster raises KeyError."""
        clusters = self.table("clusters")
        return views.cluster_articles(clusters, self.table("articles"), cluster_id, clusters)

    def recent_articles(
        self, cluster_id: int, n: int = 10, sources: Sequence[str] | None = None
    ) -> DataFrame:
        chosen = art.filter_sources(self.table("articles"), sources, self.publishers)
        members = self.table("clusters").join(chosen, "article_id")
        return trending.recent_of_cluster(members, cluster_id, n)

    def trending(self, n: int = 10, sources: Sequence[str] | None = None) -> DataFrame:
        """The first n trending clusters; with sources, of the clusters those publishers appear in."""
        ranked = self.table("trending")
        if sources:
            ranked = trending.restrict_to_clusters(ranked, self.clusters(sources))
        return trending.top_trending(ranked, n)

    def duplicates(self, threshold: float | None = None) -> DataFrame:
        """Stored near-duplicate pairs with article fields, at or above a viewing threshold."""
        pairs = self.table("duplicate_pairs")
        if threshold is not None:
            pairs = similarity.at_least_as_similar(pairs, threshold)
        full = views.enrich_pairs(pairs, self.table("articles"))
        return full.orderBy(F.col("similarity").desc(), "a_id", "b_id")

    def kpis(self) -> DataFrame:
        return views.corpus_kpis(
            self.table("articles"), self.table("clusters"), self.table("duplicate_pairs")
        )

    def feed_stats(self) -> DataFrame:
        return art.feed_stats_display(self.table("feed_stats").orderBy("pos"))

    def article_id_of(self, url: str) -> int | None:
        """Id of the first article with a url, or None."""
        found = self.table("articles").filter(F.col("url") == url)
        row = found.agg(F.min_by("article_id", "ingest_seq")).head()
        return row[0]
