"""Continuous ingest of landed feed files: into an article table, or into a whole corpus.

A micro-batch takes the place after the last position of all earlier batches, so positions never
overlap, however many partitions a batch has, and a batch that is run again gets the same range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidings.operators.articles import MIN_TEXT_LENGTH, clean_articles, new_in_small_batch
from tidings.plans import build
from tidings.sources.generations import Layout
from tidings.sources.sinks import write_batch

# Pause between two looks at the landing folder.
POLL_INTERVAL = "30 minutes"


def read_before(spark: SparkSession, table: str, batch: int) -> DataFrame | None:
    """Articles written by earlier batches, or None while there are none."""
    try:
        return spark.read.option("basePath", table).parquet(table).filter(F.col("batch") < batch)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def with_positions(records: DataFrame, last: int | None = None) -> DataFrame:
    """Records with ingest positions above ``last``, unless they have positions of their own."""
    if "ingest_seq" in records.columns:
        return records
    first = 0 if last is None else last + 1
    return records.withColumn("ingest_seq", F.monotonically_increasing_id() + F.lit(first))


def append_batch(
    records: DataFrame,
    batch: int,
    table: str,
    min_length: int = MIN_TEXT_LENGTH,
    canonical_urls: bool = True,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Clean one micro-batch, drop known urls and write it as a numbered part of the table.

    A batch that is run again after a failure compares with earlier batches only and replaces its
    own part, so nothing is lost or doubled. ``enrich`` may add columns to the new rows, such as
    their vectors.
    """
    spark = records.sparkSession
    known = read_before(spark, table, batch)
    last = known.agg(F.max("ingest_seq")).head()[0] if known is not None else None
    cleaned = clean_articles(with_positions(records, last), min_length, canonical_urls)
    fresh = cleaned if known is None else new_in_small_batch(cleaned, known)
    write_batch(fresh if enrich is None else enrich(fresh), table, batch)


def start_ingest(
    records: DataFrame,
    table: str,
    checkpoint: str,
    once: bool = True,
    interval: str = POLL_INTERVAL,
    **options,
) -> StreamingQuery:
    """Follow a stream of raw records into the article table.

    ``once`` takes what has landed and stops; otherwise the folder is looked at every ``interval``.
    The checkpoint belongs on the shared file system.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, batch_id, table, **options)

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def corpus_batch(records: DataFrame, batch: int, root: str, canonical_urls: bool = True, **options) -> int:
    """Take one micro-batch into the corpus below ``root``: articles, vectors, pairs, trends.

    The first batch with an article builds the corpus, with clusters and topics; later ones refresh it.
    Each is published as a whole, so readers never see half a batch, and one that is run again replaces
    itself. Returns the number of new articles.
    """
    spark, layout = records.sparkSession, Layout(root)
    began = layout.batches("articles")
    # Batch 0 of a corpus is the micro-batch it was built from, whatever number that had.
    if not began:
        raw = with_positions(records)
        if clean_articles(raw, canonical_urls=canonical_urls).isEmpty():
            return 0
        built = build.build_all(spark, root, raw, canonical_urls=canonical_urls, **options)
        return built.read(spark, "articles").count()
    dedup = {name: value for name, value in options.items() if name in ("threshold",)}
    return build.refresh(spark, layout, with_positions(records), batch + 1, canonical_urls=canonical_urls, **dedup)


def start_corpus_ingest(
    records: DataFrame, root: str, checkpoint: str, once: bool = True, interval: str = POLL_INTERVAL, **options
) -> StreamingQuery:
    """Follow a stream of raw records into a whole corpus, which ``Corpus`` opens at any time."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # The micro-batch is read by several stages.
        batch.persist()
        try:
            corpus_batch(batch, batch_id, root, **options)
        finally:
            batch.unpersist()

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def drop_recent_duplicates(
    articles: DataFrame, key: str = "url", event_time: str = "published", delay: str = "7 days"
) -> DataFrame:
    """First article per url within the watermark delay; state is dropped once it has passed."""
    return articles.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def stream_trending_windows(
    members: DataFrame,
    key: str = "cluster_id",
    window: str = "24 hours",
    slide: str = "1 hour",
    delay: str = "1 hour",
) -> DataFrame:
    """Articles per cluster in sliding event-time windows; late rows count until the watermark."""
    return (
        members.filter("published IS NOT NULL")
        .withWatermark("published", delay)
        .groupBy(F.window("published", window, slide).alias("_w"), key)
        .agg(F.count(F.lit(1)).alias("article_count"))
        .select(key, F.col("_w.start").alias("window_start"), "article_count")
    )
