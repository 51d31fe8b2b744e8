"""The batch build: raw records in, a folder of tables out.

Every stage writes its table and the next one reads it back, so a lost executor never costs more
than the stage that was running, and a stage can be run again on its own. Stages write to folders of
their own; a build or refresh publishes them together when it is through, so one that is empty or fails
leaves the corpus as it was.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidings.functions import dates
from tidings.operators import articles as art
from tidings.operators import cells, clustering, encode, similarity, topics, trending
from tidings.sources.generations import Layout
from tidings.sources.sinks import append_run_state, run_state, write_table


def ingest(
    spark: SparkSession, layout: Layout, raw: DataFrame, canonical_urls: bool = False,
    cap: int | None = None, keep: str = "oldest",
) -> None:
    """Clean raw records and replace the article table, all its batches, with them.

    Without a single article left, or if the write fails, the old table stays.
    """
    cleaned = art.clean_articles(raw, canonical_urls=canonical_urls)
    kept = cleaned if cap is None else art.cap_corpus(cleaned, cap, keep)
    written = Observation()
    counted = with_identity(kept).observe(written, F.count(F.lit(1)).alias("rows"))
    place = layout.fresh("articles", 0)
    write_table(counted, f"{layout.root}/{place.path}")
    total = written.get["rows"]
    if not total:
        raise ValueError("no articles remained after cleaning")
    layout.publish(place, anew=True)
    append_run_state(run_state(spark, total, total, 0), layout.path("run_log"))


def with_identity(cleaned: DataFrame) -> DataFrame:
    """Article id and parsed date next to the cleaned fields."""
    return cleaned.select(
        F.col("ingest_seq").alias("article_id"), "*", dates.parse_date(F.col("date")).alias("published")
    )


def append(
    spark: SparkSession, layout: Layout, raw: DataFrame, batch: int, canonical_urls: bool = False
) -> int:
    """Add the records whose url is new as one numbered batch; returns how many there were.

    Running a batch again replaces it. The corpus is not rewritten, so the cost follows the batch.
    """
    existing = layout.read(spark, "articles").filter(F.col("batch") < batch)
    last = existing.agg(F.max("ingest_seq")).head()[0] or 0
    cleaned = art.clean_articles(raw, canonical_urls=canonical_urls)
    fresh = art.new_in_small_batch(cleaned, existing)
    numbered = fresh.withColumn("ingest_seq", F.col("ingest_seq") + last + 1)
    place = layout.fresh("articles", batch)
    write_table(with_identity(numbered), f"{layout.root}/{place.path}")
    added = spark.read.parquet(f"{layout.root}/{place.path}").count()
    layout.publish(place)
    state = run_state(spark, added, existing.count() + added, 0)
    append_run_state(state, layout.path("run_log"))
    return added


def embed(spark: SparkSession, layout: Layout, batch: int = 0) -> None:
    """Vectors of the articles that have none; batch 0 also fits and stores the encoder.

    A later batch encodes its own articles, and those of earlier batches that were never encoded; the
    rest of the corpus is not read.
    """
    articles = layout.read(spark, "articles")
    if batch == 0:
        encoder = encode.fit_text_encoder(articles)
        place = layout.fresh("encoder")
        encoder.write().save(f"{layout.root}/{place.path}")
        layout.publish(place)
        missing = {0}
    else:
        encoder = PipelineModel.load(layout.path("encoder"))
        missing = {n for n in layout.batches("articles") if n < batch} - layout.batches("embeddings") | {batch}
    for n in sorted(missing):
        chosen = articles if batch == 0 else articles.filter(F.col("batch") == n)
        vectors = encode.encode_texts(chosen.select("article_id", "url", "domain", "text"), encoder)
        layout.put(vectors.drop("text"), "embeddings", n, anew=batch == 0)


def cluster(
    spark: SparkSession, layout: Layout, k: int | None = None,
    k_range: Iterable[int] = clustering.K_RANGE,
) -> int:
    """Clusters, coordinates and centroids of all vectors; returns the number of clusters."""
    found = clustering.cluster_corpus(layout.read(spark, "embeddings"), k, k_range)
    layout.put(found.points, "clusters")
    layout.put(found.centroids, "centroids")
    return found.k


def label(spark: SparkSession, layout: Layout) -> None:
    """Topic keywords and labels of all clusters."""
    members = layout.read(spark, "clusters").join(layout.read(spark, "articles"), "article_id")
    layout.put(topics.cluster_topics(members, max_features=topics.MAX_FEATURES), "topics")


def deduplicate(
    spark: SparkSession, layout: Layout, k: int = similarity.NEIGHBOURS,
    threshold: float = similarity.SIMILARITY_THRESHOLD, **options,
) -> None:
    """Near-duplicate pairs of the whole corpus, and the index that later batches are joined with."""
    vectors, articles = layout.read(spark, "embeddings"), layout.read(spark, "articles")
    found = similarity.nearest_neighbours(vectors, k=k, threshold=threshold, **options)
    layout.put(found, "neighbours", 0, anew=True)
    index = similarity.vector_index(vectors) if threshold >= 0 else None
    if index is not None:
        tiling, placed = index
        layout.put(cells.tiling_table(spark, tiling), "vector_tiling")
        _put_cells(spark, layout, placed, 0)
    lists = similarity.latest_lists(layout.read(spark, "neighbours"))
    layout.put(similarity.pairs_of(lists, articles), "duplicate_pairs")


def _put_cells(spark: SparkSession, layout: Layout, placed: DataFrame, batch: int) -> None:
    """Store placed vectors by cell (a bounded number of folders), and the bounds of their tiles."""
    by_tile = placed.repartitionByRange("tile", "id")
    layout.put(by_tile, "vector_cells", batch, anew=batch == 0, partition_by=("cell",))
    stored = layout.read(spark, "vector_cells").filter(F.col("batch") == batch)
    layout.put(cells.ring_table(stored), "vector_rings", batch, anew=batch == 0)


def deduplicate_batch(
    spark: SparkSession, layout: Layout, batch: int, k: int = similarity.NEIGHBOURS,
    threshold: float = similarity.SIMILARITY_THRESHOLD,
) -> None:
    """Pairs after a batch: its vectors meet the cells they come near, and change only lists they enter."""
    if not layout.has("vector_tiling"):
        deduplicate(spark, layout, k=k, threshold=threshold)
        return
    tiling = cells.read_tiling(layout.read(spark, "vector_tiling"))
    vectors = layout.read(spark, "embeddings").filter(F.col("batch") == batch)
    _put_cells(spark, layout, similarity.place_in(vectors, tiling), batch)
    indexed, bounds, lists = (layout.read(spark, n) for n in ("vector_cells", "vector_rings", "neighbours"))
    fresh, known = indexed.filter(F.col("batch") == batch), indexed.filter(F.col("batch") < batch)
    earlier = similarity.latest_lists(lists.filter(F.col("batch") < batch))
    bounds = bounds.filter(F.col("batch") < batch)
    changed = similarity.neighbours_after(fresh, known, bounds, tiling, earlier, k, threshold)
    layout.put(changed, "neighbours", batch)
    lists = similarity.latest_lists(layout.read(spark, "neighbours"))
    layout.put(similarity.pairs_of(lists, layout.read(spark, "articles")), "duplicate_pairs")


def rank_trends(
    spark: SparkSession, layout: Layout, reference: str | datetime | None = "auto"
) -> None:
    """Trending table of the current clusters."""
    fields = layout.read(spark, "articles").select("article_id", "title", "url", "published")
    members = layout.read(spark, "clusters").join(fields, "article_id", "left")
    ranked = trending.trending(members, layout.read(spark, "topics"), reference)
    layout.put(ranked, "trending")


def feed_report(spark: SparkSession, layout: Layout, **options) -> None:
    layout.put(art.feed_stats(layout.read(spark, "articles"), **options), "feed_stats")


def build_all(
    spark: SparkSession,
    root: str,
    raw: DataFrame,
    k: int | None = None,
    k_range: Iterable[int] = clustering.K_RANGE,
    canonical_urls: bool = False,
    reference: str | datetime | None = "auto",
    **dedup_options,
) -> Layout:
    """All stages from raw records to trends, published together."""
    layout = Layout(root).draft()
    ingest(spark, layout, raw, canonical_urls)
    embed(spark, layout)
    cluster(spark, layout, k, k_range)
    label(spark, layout)
    deduplicate(spark, layout, **dedup_options)
    rank_trends(spark, layout, reference)
    feed_report(spark, layout)
    return layout.commit()


def refresh(
    spark: SparkSession, layout: Layout, raw: DataFrame, batch: int, recluster: bool = False,
    canonical_urls: bool = False, **options,
) -> int:
    """Append new articles, embed them and renew duplicates and trends, published together.

    Clusters stay as they are unless ``recluster`` is set; new articles are unclustered until then.
    """
    draft = layout.draft()
    added = append(spark, draft, raw, batch, canonical_urls)
    if added:
        embed(spark, draft, batch)
        deduplicate_batch(spark, draft, batch, **options)
        feed_report(spark, draft)
    if recluster:
        cluster(spark, draft)
        label(spark, draft)
    rank_trends(spark, draft)
    draft.commit()
    return added
