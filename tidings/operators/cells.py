"""An exact index of vectors: k-means cells, cut into distance rings, compared tile by tile.

Every vector belongs to its nearest centre; the vectors of a cell are cut by their angle to it into rings
of bounded size, the tiles. Within its own tile a vector finds its first ``k`` neighbours, and the angle
to the last of them (or the threshold's angle, if less) is its reach: nothing further away can matter to
it. Angles obey the triangle inequality, so a vector can matter to a tile, or the tile to it, only if its
angle to the tile's centre is within that reach of the tile's ring, and if its distance to the plane
between the two centres is. The rows of two tiles that may concern each other meet in one task, once for
both directions. Nothing is missed, and a tile pair of which one side is empty costs nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.operators.kernels import best_columns, best_of_pairs, close_pairs, matrix, unit_rows
from tidings.sources.layout import materialize

#: Most rows of a tile while there are fewer than ``MAX_TILES`` of them; beyond, tiles grow instead.
TILE_ROWS, MAX_TILES = 16_384, 65_536
#: A cell holds about four times the root of the corpus, at least so many rows; centres are bounded.
LEAST_CELL_ROWS, MAX_CENTRES = 256, 2048
#: Rows of the sample per centre, and rounds of k-means on it.
SAMPLE_PER_CENTRE, ROUNDS = 8, 6
#: A cell has at most so many rings; further rows of a ring are dealt by a hash of their id.
MAX_RINGS = 64
#: Rows scored at a time, and (row, tile) pairs looked at when visits are worked out.
SLICE_ROWS, SLICE_CELLS = 1024, 200_000
_SLACK = 1e-7

PLACED = "id BIGINT, embedding ARRAY<FLOAT>, cell INT, angle DOUBLE, tile INT"
SEEDED = f"{PLACED}, reach DOUBLE, others ARRAY<BIGINT>, similarities ARRAY<DOUBLE>"
VISITS = "a INT, b INT, tile INT, id BIGINT, embedding ARRAY<FLOAT>, reach DOUBLE"
EDGES = "id BIGINT, other BIGINT, similarity DOUBLE"


def sample_vectors(vectors: DataFrame, total: int, wanted: int) -> np.ndarray:
    """Up to ``wanted`` unit vectors, those with the lowest hashes of their ids.

    A first filter on the hash leaves a few times as many over all tasks, whatever the input's size.
    """
    keep_one_in = max(1, total // (4 * max(1, wanted)))
    candidates = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(keep_one_in)) == 0)
    chosen = candidates.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(wanted).select("embedding").toArrow()
    rows = unit_rows(matrix(chosen.column(0))) if chosen.num_rows else np.empty((0, 0))
    return rows[np.linalg.norm(rows, axis=1) > 0] if rows.size else rows


def fit_centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit centres by a few rounds of k-means on a bounded sample. They cut up work, never results."""
    if not len(sample):
        return np.empty((0, 0))
    centres = np.unique(sample[:: max(1, len(sample) // max(1, count))][:count], axis=0)
    for _ in range(ROUNDS):
        home = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 1e-12, sums / np.where(lengths > 1e-12, lengths, 1.0), centres)
    return centres


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def snapped(cosines: np.ndarray) -> np.ndarray:
    """Cosines in which rounding does not tell equal directions apart."""
    cosines[cosines > 1.0 - 1e-12] = 1.0
    return cosines


@dataclass(frozen=True)
class Tiling:
    """Centres, and how each cell is cut: inner ring edges, rings and hash parts, first tile number."""

    centres: np.ndarray
    edges: np.ndarray
    parts: np.ndarray
    first: np.ndarray

    @property
    def cell_of_tile(self) -> np.ndarray:
        rings = np.isfinite(self.edges).sum(axis=1) + 1
        return np.repeat(np.arange(len(self.centres)), rings * self.parts)

    def tiles(self, cell: np.ndarray, angle: np.ndarray, ids: np.ndarray) -> np.ndarray:
        ring = (angle[:, None] >= self.edges[cell]).sum(axis=1)
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        part = (mixed % self.parts[cell].astype(np.uint64)).astype(np.int64)
        return self.first[cell] + ring * self.parts[cell] + part


def _assign(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosines = unit_rows(matrix(batch.column(1))) @ centres.T
                cell = cosines.argmax(axis=1)
                angle = angles(cosines[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)],
                    names=["id", "embedding", "cell", "angle"],
                )

    return run


def assign(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Each vector (id, embedding) with its cell and its angle to the centre."""
    return vectors.mapInArrow(_assign(centres), "id BIGINT, embedding ARRAY<FLOAT>, cell INT, angle DOUBLE")


def fit_tiling(assigned: DataFrame, centres: np.ndarray, total: int, tile_rows: int) -> Tiling:
    """Ring edges from each cell's quantiles; one row per cell reaches the driver."""
    tile_rows = max(tile_rows, math.ceil(2 * total / MAX_TILES))
    steps = [i / MAX_RINGS for i in range(1, MAX_RINGS)]
    found = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("angle", steps).alias("q"))
    edges = np.full((len(centres), MAX_RINGS - 1), np.inf)
    parts = np.ones(len(centres), np.int64)
    for row in found.collect():
        rings = min(MAX_RINGS, math.ceil(row["n"] / tile_rows))
        picked = sorted({row["q"][MAX_RINGS * r // rings - 1] for r in range(1, rings)})
        edges[row["cell"], : len(picked)] = picked
        parts[row["cell"]] = max(1, math.ceil(row["n"] / ((len(picked) + 1) * tile_rows)))
    sizes = (np.isfinite(edges).sum(axis=1) + 1) * parts
    return Tiling(centres, edges, parts, np.concatenate([[0], np.cumsum(sizes)[:-1]]))


def place(assigned: DataFrame, tiling: Tiling) -> DataFrame:
    """Assigned vectors with the number of their tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cell, angle = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            tile = tiling.tiles(cell, angle, ids).astype(np.int32)
            names = ["id", "embedding", "cell", "angle", "tile"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile)], names=names)

    return assigned.mapInArrow(run, PLACED)


def _best_in(
    a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, k: int, floor: float, both: bool,
    floors: tuple[np.ndarray, np.ndarray] | None = None,
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ``k`` best rows of ``b`` above the floor for each row of ``a`` (own row, other row, cosine), and the reverse.

    Above a threshold there are mostly few pairs, which are found without ranking all scores. ``floors`` are the
    cosines of neighbours that the rows have already: what is below both floors of a pair may be left out.
    """
    pairs = close_pairs(a, b, floor, floors) if floor > 0 or floors is not None else None
    sides = [(a_ids, b_ids), (b_ids, a_ids)] if both else [(a_ids, b_ids)]
    if pairs is not None:
        rows, cols, scores = pairs[0], pairs[1], snapped(pairs[2])
        kept = (scores > floor) & (a_ids[rows] != b_ids[cols])
        ends, scores = [rows[kept], cols[kept]], scores[kept]
        found = []
        for i, (_, other_ids) in enumerate(sides):
            own, other = ends[i], ends[1 - i]
            best = best_of_pairs(own, scores, other_ids[other], k)
            found.append((own[best], other[best], scores[best]))
        return found
    scores = snapped(a @ b.T)
    scores[(scores <= floor) | (a_ids[:, None] == b_ids[None, :])] = -np.inf
    found = []
    for i, (_, other_ids) in enumerate(sides):
        side = scores.T if i else scores
        rows, cols = best_columns(side, other_ids, k)
        found.append((rows, cols, side[rows, cols]))
    return found


def _seed(k: int, threshold: float | None):
    floor = -math.inf if threshold is None else threshold
    widest = math.pi if floor < 0 else math.acos(min(1.0, floor))

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy(zero_copy_only=False)
        units = unit_rows(matrix(table.column("embedding")))
        reach = np.full(len(ids), widest)
        others: list = []
        similarities: list = []
        for start in range(0, len(ids), SLICE_ROWS):
            part = slice(start, start + SLICE_ROWS)
            rows, cols, best = _best_in(units[part], units, ids[part], ids, k, floor, False)[0]
            bounds = np.searchsorted(rows, np.arange(len(units[part]) + 1))
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                others.append(ids[cols[a:b]])
                similarities.append(best[a:b])
                if b - a == k and k:
                    reach[start + i] = min(widest, math.acos(max(-1.0, min(1.0, best[b - 1]))))
        if floor < 0:  # a zero vector has no angle to anything
            reach[~units.any(axis=1)] = math.pi
        extra = {"reach": pa.array(reach), "others": pa.array(others, pa.list_(pa.int64()))}
        extra["similarities"] = pa.array(similarities, pa.list_(pa.float64()))
        for name, column in extra.items():
            table = table.append_column(name, column)
        return table

    return run


def seed(placed: DataFrame, k: int, threshold: float | None) -> DataFrame:
    """Each vector with its ``k`` best neighbours in its own tile, and the reach they leave it."""
    return placed.groupBy("tile").applyInArrow(_seed(k, threshold), SEEDED)


@dataclass(frozen=True)
class Rings:
    """What the tiles hold: least and greatest angle to their centre, and greatest reach; empty ones are NaN."""

    low: np.ndarray
    high: np.ndarray
    reach: np.ndarray


def rings(rows: DataFrame, tiling: Tiling) -> Rings:
    """Bounds of every tile (one row per tile reaches the driver; their number is bounded)."""
    found = rows.groupBy("tile").agg(F.min("angle"), F.max("angle"), F.max("reach")).collect()
    bounds = np.full((3, len(tiling.cell_of_tile)), np.nan)
    for tile, *values in found:
        bounds[:, tile] = values
    return Rings(*bounds)


def visited(units: np.ndarray, cell: np.ndarray, reach: np.ndarray, tiling: Tiling, held: Rings) -> np.ndarray:
    """Which tiles hold something that a vector may concern or be concerned by (rows by tiles)."""
    centres, of_tile = tiling.centres, tiling.cell_of_tile
    cosines = units @ centres.T
    need = np.maximum(reach[:, None], held.reach[None, :]) + _SLACK
    angle = angles(cosines)[:, of_tile]
    with np.errstate(invalid="ignore"):
        near = (angle >= held.low - need) & (angle <= held.high + need)
        gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (centres[cell] @ centres.T)))[:, of_tile]
        beyond = cosines[np.arange(len(cell)), cell][:, None] - cosines[:, of_tile]
        return near & (beyond <= 2.0 * np.sin(np.minimum(need, math.pi) / 2.0) * gap + _SLACK)


def _visits(tiling: Tiling, held: Rings):
    step = max(1, SLICE_CELLS // max(1, len(held.low)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                rows = batch.slice(start, step)
                cell, tile, reach = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "tile", "reach"))
                near = visited(unit_rows(matrix(rows.column("embedding"))), cell, reach, tiling, held)
                near[np.arange(len(tile)), tile] = False
                row, other = np.nonzero(near)
                own, picked = tile[row], pa.array(row)
                arrays = [np.minimum(own, other), np.maximum(own, other), own]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(x.astype(np.int32)) for x in arrays),
                        rows.column("id").take(picked),
                        rows.column("embedding").take(picked),
                        rows.column("reach").take(picked),
                    ],
                    names=["a", "b", "tile", "id", "embedding", "reach"],
                )

    return run


def visits(seeded: DataFrame, tiling: Tiling, held: Rings) -> DataFrame:
    """One row for each other tile a vector has to meet, keyed by the unordered pair of tiles."""
    return seeded.select("id", "embedding", "cell", "tile", "reach").mapInArrow(_visits(tiling, held), VISITS)


def _compare(k: int, threshold: float | None):
    floor = -math.inf if threshold is None else threshold

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tile = table.column("tile").to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy(zero_copy_only=False)
        # Nothing that is further away than its reach is among a row's best.
        least = np.cos(table.column("reach").to_numpy(zero_copy_only=False)) - _SLACK
        left, right = np.flatnonzero(tile == key[0].as_py()), np.flatnonzero(tile == key[1].as_py())
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(left) and len(right):
            units = unit_rows(matrix(table.column("embedding")))
            for start in range(0, len(left), SLICE_ROWS):
                part = left[start : start + SLICE_ROWS]
                there, back = _best_in(units[part], units[right], ids[part], ids[right], k, floor, True, (least[part], least[right]))
                found.append((ids[part][there[0]], ids[right][there[1]], there[2]))
                found.append((ids[right][back[0]], ids[part][back[1]], back[2]))
        own, other, similarity = (np.concatenate(side) for side in zip(*found, strict=True))
        return pa.table({"id": own, "other": other, "similarity": similarity})

    return run


def compare(met: DataFrame, k: int, threshold: float | None) -> DataFrame:
    """Edges between the two tiles of each pair, at most ``k`` for a vector and slice of the other tile."""
    return met.groupBy("a", "b").applyInArrow(_compare(k, threshold), EDGES)


def zero_free(vectors: DataFrame) -> DataFrame:
    """Vectors that have a direction."""
    return vectors.filter(F.exists("embedding", lambda x: x != 0))


def tiling_table(spark: SparkSession, tiling: Tiling) -> DataFrame:
    """A tiling as a small table, one row per cell."""
    rows = [
        (i, c.tolist(), e[np.isfinite(e)].tolist(), int(p), int(f))
        for i, (c, e, p, f) in enumerate(zip(tiling.centres, tiling.edges, tiling.parts, tiling.first, strict=True))
    ]
    return spark.createDataFrame(rows, "cell INT, centre ARRAY<DOUBLE>, edges ARRAY<DOUBLE>, parts BIGINT, first BIGINT")


def read_tiling(table: DataFrame) -> Tiling:
    """A tiling from its table (a bounded number of cells)."""
    rows = sorted(table.collect(), key=lambda r: r["cell"])
    edges = np.full((len(rows), MAX_RINGS - 1), np.inf)
    for row in rows:
        edges[row["cell"], : len(row["edges"])] = row["edges"]
    centres = np.array([r["centre"] for r in rows])
    parts, first = (np.array([r[c] for r in rows], np.int64) for c in ("parts", "first"))
    return Tiling(centres, edges, parts, first)


def ring_table(placed: DataFrame) -> DataFrame:
    """Bounds of the tiles of placed vectors, to be kept beside them."""
    return placed.groupBy("tile").agg(F.min("angle").alias("low"), F.max("angle").alias("high"))


def edges_to_known(
    fresh: DataFrame, known: DataFrame, bounds: DataFrame, tiling: Tiling, k: int, threshold: float, total: int
) -> DataFrame:
    """Edges, in both directions, between a batch of placed vectors and the stored ones they come near.

    ``known`` is the stored table of placed vectors, ``bounds`` its ring tables; only cells that hold a
    visited tile are read. A tile's visitors are dealt into blocks of bounded size.
    """
    reach = math.acos(min(1.0, threshold))
    found = bounds.groupBy("tile").agg(F.min("low"), F.max("high")).collect()
    limits = np.full((3, len(tiling.cell_of_tile)), np.nan)
    for tile, low, high in found:
        limits[:, tile] = low, high, 0.0
    held = Rings(*limits)
    step = max(1, SLICE_CELLS // len(held.low))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                rows = batch.slice(start, step)
                cell = rows.column("cell").to_numpy(zero_copy_only=False)
                units = unit_rows(matrix(rows.column("embedding")))
                row, tile = np.nonzero(visited(units, cell, np.full(len(cell), reach), tiling, held))
                picked = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(tile.astype(np.int32)),
                        rows.column("id").take(picked),
                        rows.column("embedding").take(picked),
                    ],
                    names=["b", "id", "embedding"],
                )

    asked = fresh.select("id", "embedding", "cell").mapInArrow(run, "b INT, id BIGINT, embedding ARRAY<FLOAT>")
    blocks = max(1, math.ceil(total / TILE_ROWS))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    asked = materialize(asked.withColumns({"block": block, "tile": F.lit(-1), "reach": F.lit(reach)}))
    tiles = [row["b"] for row in asked.select("b").distinct().collect()]
    read = sorted({int(c) for c in tiling.cell_of_tile[tiles]}) if tiles else []
    near = known.filter(F.col("cell").isin(read)).join(F.broadcast(asked.select(F.col("b").alias("tile")).distinct()), "tile")
    homes = near.select(
        F.col("tile").alias("b"), "id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "tile",
        F.lit(reach).alias("reach"),
    )
    met = asked.select(homes.columns).unionByName(homes).withColumn("a", F.lit(-1))
    return met.groupBy("a", "b", "block").applyInArrow(_compare(k, threshold), EDGES)


def cell_count(total: int) -> int:
    """How many centres a corpus of ``total`` vectors gets."""
    rows = min(TILE_ROWS, max(LEAST_CELL_ROWS, 4 * math.isqrt(total)))
    return min(MAX_CENTRES, max(1, total // rows))


def seeded_edges(seeded: DataFrame) -> DataFrame:
    """The edges found within tiles."""
    pair = F.explode(F.arrays_zip("others", "similarities")).alias("p")
    return seeded.select("id", pair).select("id", F.col("p.others").alias("other"), F.col("p.similarities").alias("similarity"))


def compared_pairs(seeded: DataFrame, met: DataFrame) -> int:
    """How many unordered pairs of vectors are scored in all."""
    within = seeded.groupBy("tile").count().agg(F.sum(F.expr("count * (count - 1) div 2"))).head()[0] or 0
    sides = met.groupBy("a", "b").agg(F.count_if(F.col("tile") == F.col("a")).alias("x"), F.count(F.lit(1)).alias("n"))
    return within + (sides.agg(F.sum(F.expr("x * (n - x)"))).head()[0] or 0)
