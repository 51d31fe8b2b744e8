"""Nearest neighbours and near-duplicate pairs over vectors.

How the join scales:

* Copies of one vector are collapsed before anything is compared, and expanded afterwards. Ties
  rank by id, so among copies only the ``k + 1`` lowest ids can ever be somebody's neighbour.
* ``exact``: k-means cells cut into rings (``cells``). What a vector finds in its own tile bounds how
  far it has to look, and the triangle inequality says which tiles lie that near; each unordered pair
  of tiles meets once, in one task of bounded size.
* ``lsh``: signs of projections on random directions, packed into bands. Vectors meet if all bits of
  some band agree. A bucket is cut into tiles too, so a hot one gives many tasks.
* A task returns at most ``k`` neighbours per vector and slice, so a dense group of near copies is
  never listed pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.operators import cells
from tidings.operators.kernels import best_columns, matrix, unit_rows
from tidings.sources.layout import materialize

# Neighbours per article, similarity above which two articles are near duplicates.
NEIGHBOURS = 10
SIMILARITY_THRESHOLD = 0.92

# A tile pair is one task call: two times this many vectors in memory, scored in slices.
TILE_ROWS = 16_384
SLICE_ROWS = 1024
# Sign bits of a band and number of bands: at a similarity of 0.92 a band agrees with probability 0.19,
# some band with 0.97; vectors at right angles meet with 0.004.
BAND_BITS, BANDS = 12, 16
# Cell sizes (one short row per cell) are broadcast up to this many cells.
MAX_BROADCAST_CELLS = 100_000

_EDGES = "id BIGINT, other BIGINT, similarity DOUBLE"


def _standard(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    return vectors.filter(F.col(vector_column).isNotNull()).select(
        F.col(id_column).cast("bigint").alias("id"),
        F.col(vector_column).cast("array<float>").alias("embedding"),
    )


def _both_roles(celled: DataFrame) -> DataFrame:
    roles = F.explode(F.array(F.lit(False), F.lit(True)))
    return celled.withColumn("visitor", roles).select("cell", "visitor", "id", "embedding")


def band_keys(units: np.ndarray, bits: int, bands: int, seed: int) -> np.ndarray:
    """One number per vector and band: its packed sign bits (all must agree), and the band above them."""
    planes = np.random.default_rng(seed).normal(size=(bands * bits, units.shape[1]))
    signs = (units @ planes.T >= 0).reshape(len(units), bands, bits)
    return signs @ (1 << np.arange(bits)) + (np.arange(bands) << bits)


def _hash_cells(vectors: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """A row per band: vectors that share a cell agree in all sign bits of one band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(unit_rows(matrix(batch.column(1))), bits, bands, seed)
                rows = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), bands)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().astype(np.int64)), *rows.columns], names=["cell", "id", "embedding"]
                )

    return vectors.mapInArrow(run, "cell BIGINT, id BIGINT, embedding ARRAY<FLOAT>")


def _cut_into_tiles(celled: DataFrame, tile_rows: int, most_cells: int) -> DataFrame:
    """Give each row its tile and one copy per opposite tile of the same cell.

    ``most_cells`` bounds the number of cells, which decides whether their sizes are broadcast.
    """

    def tiles(visitor: bool) -> F.Column:
        rows = F.count_if(F.col("visitor") == visitor)
        return F.greatest(F.ceil(rows / F.lit(tile_rows)), F.lit(1)).cast("int")

    counts = celled.groupBy("cell").agg(
        tiles(False).alias("_homes"), tiles(True).alias("_visits")
    )
    if most_cells <= MAX_BROADCAST_CELLS:
        counts = F.broadcast(counts)
    sized = celled.join(counts, "cell")
    own = F.when(F.col("visitor"), F.col("_visits")).otherwise(F.col("_homes"))
    opposite = F.when(F.col("visitor"), F.col("_homes")).otherwise(F.col("_visits"))
    placed = sized.select(
        "cell", "visitor", "id", "embedding",
        F.pmod(F.xxhash64("id"), own).cast("int").alias("_own"),
        F.explode(F.sequence(F.lit(0), opposite - 1)).alias("_opposite"),
    )
    return placed.select(
        "cell", "visitor", "id", "embedding",
        F.when(F.col("visitor"), F.col("_opposite")).otherwise(F.col("_own")).alias("home_tile"),
        F.when(F.col("visitor"), F.col("_own")).otherwise(F.col("_opposite")).alias("visit_tile"),
    )


def exact_edges(
    rows: DataFrame, distinct: DataFrame, k: int, threshold: float | None, total: int,
    cell_count: int | None = None, tile_rows: int | None = None,
) -> DataFrame:
    """Edges that hold the ``k`` best neighbours of every distinct vector; further ones may follow."""
    if threshold is not None and threshold >= 0:
        distinct = cells.zero_free(distinct)
    count = cells.cell_count(total) if cell_count is None else cell_count
    sample = cells.sample_vectors(rows, total, cells.SAMPLE_PER_CENTRE * count)
    centres = cells.fit_centres(sample, count)
    if not centres.size:  # only zero vectors, or none
        return _tile_neighbours(
            _cut_into_tiles(_both_roles(distinct.withColumn("cell", F.lit(0).cast("bigint"))), TILE_ROWS, 1), k, threshold
        )
    assigned = materialize(cells.assign(distinct, centres))
    tiling = cells.fit_tiling(assigned, centres, total, tile_rows or cells.TILE_ROWS)
    seeded = materialize(cells.seed(cells.place(assigned, tiling), k, threshold))
    met = cells.visits(seeded, tiling, cells.rings(seeded, tiling))
    return cells.seeded_edges(seeded).unionByName(cells.compare(met, k, threshold))


def _tile_neighbours(tiled: DataFrame, k: int, threshold: float | None) -> DataFrame:
    """Compare each home tile with each visitor tile; at most k rows per visitor leave a tile."""
    floor = -math.inf if threshold is None else threshold

    def compare(table: pa.Table) -> pa.Table:
        visitor = table.column("visitor").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("id").to_numpy(zero_copy_only=False)
        home_at, visit_at = np.nonzero(~visitor)[0], np.nonzero(visitor)[0]
        home_ids, visit_ids = ids[home_at], ids[visit_at]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(home_at) and len(visit_at):
            units = unit_rows(matrix(table.column("embedding")))
            homes = units[home_at].T
            for start in range(0, len(visit_at), SLICE_ROWS):
                part = slice(start, start + SLICE_ROWS)
                scores = units[visit_at[part]] @ homes
                excluded = (scores <= floor) | (visit_ids[part, None] == home_ids[None, :])
                scores[excluded] = -np.inf
                rows, cols = best_columns(scores, home_ids, k)
                found.append((visit_ids[part][rows], home_ids[cols], scores[rows, cols]))
        ids_out, others, similarities = (np.concatenate(side) for side in zip(*found))
        return pa.table({"id": ids_out, "other": others, "similarity": similarities})

    return tiled.groupBy("cell", "home_tile", "visit_tile").applyInArrow(compare, _EDGES)


def _best_edges(edges: DataFrame, k: int) -> DataFrame:
    window = W.partitionBy("id").orderBy(F.col("similarity").desc(), F.col("other"))
    return edges.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def _copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of equal vectors (``rep, own``) and their other members (``rep, id``).

    Vectors are told apart by a 128-bit hash, so the vectors themselves are not shuffled. ``rep`` is
    the lowest id of a group and ``own`` the similarity of its members to each other.
    """
    keyed = rows.select(
        "id",
        F.xxhash64("embedding").alias("_h1"),
        F.xxhash64(F.lit(1), "embedding").alias("_h2"),
        F.exists("embedding", lambda x: x != 0).cast("double").alias("_own"),
    )
    groups = (
        keyed.groupBy("_h1", "_h2")
        .agg(F.min("id").alias("rep"), F.max("_own").alias("own"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
    )
    others = keyed.join(groups, ["_h1", "_h2"]).filter("id <> rep").select("rep", "id")
    return groups.select("rep", "own"), others


def expand_copies(
    rows: DataFrame, groups: DataFrame, others: DataFrame, edges: DataFrame, k: int, threshold: float | None
) -> DataFrame:
    """Turn edges between distinct vectors into neighbours of every single id.

    Per group of copies, the ``k`` lowest ids stand for the group wherever it is a neighbour. The
    ranked candidates of a vector hold at most ``k + 1`` ids; a member takes the first ``k`` others.
    """
    members = rows.select("id").join(others, "id", "left").select(F.coalesce("rep", "id").alias("rep"), "id")
    lowest = (
        others.withColumn("_pos", F.row_number().over(W.partitionBy("rep").orderBy("id")))
        .filter(F.col("_pos") <= k)
        .select(F.col("rep").alias("other_rep"), F.col("id").alias("other"))
    )
    to_reps = edges.select(
        F.col("id").alias("rep"), F.col("other").alias("other_rep"), "similarity"
    ).unionByName(
        groups.select("rep", F.col("rep").alias("other_rep"), F.col("own").alias("similarity"))
    )
    candidates = to_reps.withColumn("other", F.col("other_rep")).unionByName(
        to_reps.join(lowest, "other_rep")
    )
    if threshold is not None:
        candidates = candidates.filter(F.col("similarity") > threshold)
    # At most (k + 1) * (k + 1) candidates per vector reach this aggregate.
    ranked = candidates.groupBy("rep").agg(
        F.slice(
            F.array_sort(
                F.collect_list(
                    F.struct((-F.col("similarity")).alias("minus"), F.col("other").alias("other"))
                )
            ),
            1,
            k + 1,
        ).alias("ranked")
    )
    chosen = F.slice(F.filter("ranked", lambda c: c["other"] != F.col("id")), 1, k)
    return (
        members.join(ranked, "rep")
        .select("id", F.posexplode(chosen).alias("_pos", "_c"))
        .select(
            "id",
            F.col("_c.other").alias("other"),
            (-F.col("_c.minus")).alias("similarity"),
            (F.col("_pos") + 1).alias("rank"),
        )
    )


def nearest_neighbours(
    vectors: DataFrame,
    k: int = NEIGHBOURS,
    threshold: float | None = None,
    method: str = "exact",
    id_column: str = "article_id",
    vector_column: str = "embedding",
    cell_count: int | None = None,
    tile_rows: int | None = None,
    band_bits: int = BAND_BITS,
    bands: int = BANDS,
    seed: int = 42,
) -> DataFrame:
    """The ``k`` most cosine-similar other articles of every article: ``id, other, similarity, rank``.

    The vectors are read several times, so they should be a stored or materialized table. Only
    neighbours strictly above ``threshold`` count. ``exact`` finds them all; ``lsh`` compares
    vectors that agree in some band of sign bits and may miss some, never adds any.
    """
    if method not in ("exact", "lsh"):
        raise ValueError(f"method must be 'exact' or 'lsh', got {method!r}")
    rows = _standard(vectors, id_column, vector_column)
    total = rows.count()
    groups, others = _copies(rows)
    distinct = rows.join(others.select("id"), "id", "left_anti")
    if method == "lsh":
        celled = _both_roles(_hash_cells(distinct, band_bits, bands, seed))
        tiled = _cut_into_tiles(celled, tile_rows or TILE_ROWS, bands << band_bits)
        # A pair may meet in several bands; one similarity per pair is kept.
        edges = _tile_neighbours(tiled, k, threshold)
        edges = edges.groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    else:
        edges = exact_edges(rows, distinct, k, threshold, total, cell_count, tile_rows)
    best = _best_edges(edges, k).drop("rank")
    return expand_copies(rows, groups, others, best, k, threshold)


def vector_index(
    vectors: DataFrame, id_column: str = "article_id", vector_column: str = "embedding"
) -> tuple[cells.Tiling, DataFrame] | None:
    """A tiling fitted to the vectors, and all that have a direction, placed in it; None without any."""
    rows = cells.zero_free(_standard(vectors, id_column, vector_column))
    total = rows.count()
    count = cells.cell_count(total)
    centres = cells.fit_centres(cells.sample_vectors(rows, total, cells.SAMPLE_PER_CENTRE * count), count)
    if not centres.size:
        return None
    assigned = materialize(cells.assign(rows, centres))
    tiling = cells.fit_tiling(assigned, centres, total, cells.TILE_ROWS)
    return tiling, cells.place(assigned, tiling)


def place_in(vectors: DataFrame, tiling: cells.Tiling, id_column: str = "article_id", vector_column: str = "embedding") -> DataFrame:
    """Further vectors, placed in a stored tiling."""
    return cells.place(cells.assign(cells.zero_free(_standard(vectors, id_column, vector_column)), tiling.centres), tiling)


def neighbours_after(
    fresh: DataFrame, known: DataFrame, bounds: DataFrame, tiling: cells.Tiling, neighbours: DataFrame,
    k: int = NEIGHBOURS, threshold: float = SIMILARITY_THRESHOLD,
) -> DataFrame:
    """New neighbour lists of all ids that a batch of placed vectors changes: ``id, other, similarity, rank``.

    ``fresh`` is the batch, ``known`` and ``bounds`` the stored vectors and their tiles, ``neighbours``
    the lists as they are. The lists equal those of a full recomputation; work follows the batch and
    the cells it comes near.
    """
    if threshold < 0:
        raise ValueError("the index has no vectors without direction, so the threshold must not be negative")
    total = fresh.count()
    across = cells.edges_to_known(fresh, known, bounds, tiling, k, threshold, total)
    own = nearest_neighbours(fresh.select("id", "embedding"), k, threshold, id_column="id").drop("rank")
    edges = materialize(across.unionByName(own))
    touched = edges.select("id").distinct()
    before = neighbours.select("id", "other", "similarity").join(touched, "id", "left_semi")
    merged = edges.unionByName(before).groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    return _best_edges(merged, k)


def latest_lists(neighbours: DataFrame) -> DataFrame:
    """Neighbour lists written in batches: an id's rows of its last batch."""
    last = neighbours.groupBy("id").agg(F.max("batch").alias("batch"))
    return neighbours.join(last, ["id", "batch"]).drop("batch")


def pairs_of(edges: DataFrame, articles: DataFrame) -> DataFrame:
    """Unordered article pairs of neighbour edges, the most similar first; blank and equal urls go."""
    pairs = (
        edges.select(
            F.least("id", "other").alias("a_id"), F.greatest("id", "other").alias("b_id"), "similarity"
        )
        .groupBy("a_id", "b_id")
        .agg(F.max("similarity").alias("similarity"))
    )

    def side(prefix: str) -> DataFrame:
        return articles.select(
            F.col("article_id").alias(f"{prefix}_id"),
            F.coalesce("title", F.lit("")).alias(f"{prefix}_title"),
            F.coalesce("url", F.lit("")).alias(f"{prefix}_url"),
        )

    joined = pairs.join(side("a"), "a_id").join(side("b"), "b_id")
    return (
        joined.filter("a_url <> '' AND b_url <> '' AND a_url <> b_url")
        .select("a_id", "a_title", "a_url", "b_id", "b_title", "b_url", "similarity")
        .orderBy(F.col("similarity").desc(), "a_id", "b_id")
    )


def near_duplicates(
    vectors: DataFrame,
    articles: DataFrame,
    k: int = NEIGHBOURS,
    threshold: float = SIMILARITY_THRESHOLD,
    **options,
) -> DataFrame:
    """Unordered pairs of near-duplicate articles, the most similar first.

    A pair counts when either article has the other among its ``k`` nearest above the threshold.
    Pairs whose urls are blank or equal are dropped after the ranks are spent, as those neighbours
    do take up rank slots.
    """
    return pairs_of(nearest_neighbours(vectors, k=k, threshold=threshold, **options), articles)


def at_least_as_similar(pairs: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """Pairs at or above a viewing threshold (inclusive, unlike the strict one they are built with)."""
    return pairs.filter(F.col("similarity") >= threshold)
