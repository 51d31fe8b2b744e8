"""Semantic top-k search and find-similar."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.functions.publishers import DEFAULT_PUBLISHERS, Publisher
from tidings.operators.articles import filter_sources
from tidings.operators.kernels import best_columns, matrix, unit_rows
from tidings.operators.similarity import TILE_ROWS, _cut_into_tiles, _tile_neighbours
from tidings.sources.layout import materialize

# Hits per search and the factor and floor of an over-fetching filtered search.
HITS = 10
OVERFETCH_FACTOR, OVERFETCH_FLOOR = 10, 50

# Query sets up to this size ride along with the tasks; larger ones are joined in tiles.
MAX_SHIPPED_QUERIES = 1024

_SCORED = "query_id BIGINT, article_id BIGINT, score DOUBLE"


def _scan_with_queries(corpus: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """One pass over the corpus; each task keeps the k best articles of every query."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_rows = np.empty(0, dtype=np.int64)
        kept_ids = np.empty(0, dtype=np.int64)
        kept_scores = np.empty(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            article_ids = batch.column(0).to_numpy(zero_copy_only=False)
            scores = queries @ unit_rows(matrix(batch.column(1))).T
            rows, cols = best_columns(scores, article_ids, k)
            kept_rows = np.concatenate([kept_rows, rows])
            kept_ids = np.concatenate([kept_ids, article_ids[cols]])
            kept_scores = np.concatenate([kept_scores, scores[rows, cols]])
            order = np.lexsort((kept_ids, -kept_scores, kept_rows))
            ordered = kept_rows[order]
            starts = np.searchsorted(ordered, np.arange(len(ids)))
            order = order[np.arange(len(order)) - starts[ordered] < k]
            kept_rows, kept_ids, kept_scores = kept_rows[order], kept_ids[order], kept_scores[order]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[kept_rows]), pa.array(kept_ids), pa.array(kept_scores)],
            names=["query_id", "article_id", "score"],
        )

    return corpus.mapInArrow(scan, _SCORED)


def _tiled_with_queries(corpus: DataFrame, queries: DataFrame, k: int, tile_rows: int) -> DataFrame:
    """Query sets too large to ship: corpus tiles meet query tiles.

    Ids of the two sides are kept apart by sign, so a query never excludes the article of its id.
    """
    homes = corpus.select(
        F.lit(False).alias("visitor"), F.col("article_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    visits = queries.select(
        F.lit(True).alias("visitor"), (-F.col("query_id") - 1).alias("id"), "embedding"
    )
    celled = homes.unionByName(visits).withColumn("cell", F.lit(0).cast("bigint"))
    found = _tile_neighbours(_cut_into_tiles(celled, tile_rows, most_cells=1), k, None)
    return found.select(
        (-F.col("id") - 1).alias("query_id"),
        F.col("other").alias("article_id"),
        F.col("similarity").alias("score"),
    )


def search_many(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = HITS,
    max_shipped: int = MAX_SHIPPED_QUERIES,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Top-k articles of every query vector: ``query_id, article_id, score, rank``.

    ``corpus`` holds ``article_id, embedding``, ``queries`` holds ``query_id, embedding``. The size
    of the query set is checked: a small one is shipped with the scan, so the corpus is read once
    and never shuffled; a larger one is joined tile by tile. Both score in double precision. Queries
    without an id or a vector have no hits.
    """
    scored = _scored(corpus, queries, k, max_shipped, tile_rows)
    window = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("article_id"))
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def _scored(corpus: DataFrame, queries: DataFrame, k: int, max_shipped: int, tile_rows: int) -> DataFrame:
    """Hits that hold the k best of every query: ``query_id, article_id, score``."""
    rows = corpus.filter("embedding IS NOT NULL").select(
        F.col("article_id").cast("bigint").alias("article_id"),
        F.col("embedding").cast("array<float>").alias("embedding"),
    )
    wanted = queries.filter("query_id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("query_id").cast("bigint").alias("query_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    shipped = wanted.limit(max_shipped + 1).collect()
    if not shipped:
        return wanted.sparkSession.createDataFrame([], _SCORED)
    if len(shipped) > max_shipped:
        return _tiled_with_queries(rows, wanted, k, tile_rows)
    ids = np.array([row["query_id"] for row in shipped], dtype=np.int64)
    vectors = unit_rows(np.array([row["embedding"] for row in shipped], dtype=np.float64))
    return _scan_with_queries(rows, ids, vectors, k)


def _first_hits(hits: DataFrame, k: int) -> DataFrame:
    """The k best of one query's hits with their rank; every task passes on at most k of its own."""
    best = [F.col("score").desc(), F.col("article_id")]
    # Only the k rows of the limit reach this window.
    return hits.orderBy(*best).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*best)))


def search(corpus: DataFrame, vector: Sequence[float], k: int = HITS) -> DataFrame:
    """Top-k articles for one query vector: ``article_id, score, rank``."""
    row = [(0, [float(x) for x in vector])]
    query = corpus.sparkSession.createDataFrame(row, "query_id BIGINT, embedding ARRAY<DOUBLE>")
    hits = _scored(corpus, query, k, MAX_SHIPPED_QUERIES, TILE_ROWS)
    return _first_hits(hits.select("article_id", "score"), k)


def vector_of(corpus: DataFrame, article_id: int) -> list[float]:
    """Stored vector of an article; an unknown id raises IndexError."""
    found = corpus.filter(F.col("article_id") == article_id).select("embedding").head(1)
    if not found or found[0][0] is None:
        raise IndexError(f"article_id {article_id!r} not found")
    return found[0][0]


def find_similar(corpus: DataFrame, article_id: int, k: int = HITS) -> DataFrame:
    """The k articles most similar to a stored one, which itself is left out."""
    vector = vector_of(corpus, article_id)
    return search(corpus.filter(F.col("article_id") != article_id), vector, k)


def search_sources(
    corpus: DataFrame,
    articles: DataFrame,
    vector: Sequence[float],
    slugs: Sequence[str] | None,
    k: int = HITS,
    exact: bool = True,
    configured: Sequence[Publisher] = DEFAULT_PUBLISHERS,
) -> DataFrame:
    """Top-k articles of the selected publishers.

    ``exact`` filters first, so k hits are returned whenever k exist. Otherwise a larger top-k is
    fetched and filtered afterwards, which may leave fewer. A corpus that carries ``domain`` itself
    is filtered in its scan and needs no join.
    """
    domains = articles.select("article_id", "domain")
    if not slugs:
        return search(corpus, vector, k)
    if exact and "domain" in corpus.columns:
        return search(filter_sources(corpus, slugs, configured), vector, k)
    if exact:
        allowed = filter_sources(domains, slugs, configured).select("article_id")
        return search(corpus.join(allowed, "article_id", "left_semi"), vector, k)
    fetched = search(corpus, vector, max(k * OVERFETCH_FACTOR, OVERFETCH_FLOOR))
    # The fetched rows are a top-k of a size set by ``k``: the articles are read where they lie.
    kept = filter_sources(domains.join(F.broadcast(fetched), "article_id"), slugs, configured)
    return _first_hits(kept.select("article_id", "score"), k)


def describe_hits(hits: DataFrame, articles: DataFrame) -> DataFrame:
    """Hits with title, url, date and domain of their articles.

    The hits are stored, since they are read twice. Their articles are picked first, by a join that can
    broadcast the hits, so that the article table is scanned but not shuffled for them.
    """
    hits = materialize(hits)
    fields = ("title", "url", "date", "domain")
    wanted = hits.select("article_id").distinct()
    meta = articles.select("article_id", *fields).join(wanted, "article_id", "left_semi")
    blank = [F.coalesce(name, F.lit("")).alias(name) for name in fields]
    return hits.join(meta, "article_id", "left").select(*hits.columns, *blank)
