"""K-means clusters, the choice of k, assignment to centroids and 2-D coordinates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidings.functions.vectors import as_double
from tidings.operators.kernels import matrix
from tidings.sources.layout import materialize

# Range of cluster counts tried and the random seed.
K_RANGE = range(5, 30)
SEED = 42
# Centres start from a sample of so many vectors per cluster of the largest k; rounds of Lloyd's steps, and
# the change of centres (squared) below which they end.
START_ROWS, ROUNDS, TOLERANCE = 64, 20, 1e-8

# Centroids that are scored at a time; a longer table is taken in blocks.
CENTROID_BLOCK = 4096


def unit_features(vectors: DataFrame, id_column: str = "article_id") -> DataFrame:
    """Unit-length ML vectors in column ``features``."""
    raw = vectors.filter("embedding IS NOT NULL").select(
        F.col(id_column).alias("article_id"), array_to_vector(as_double(F.col("embedding"))).alias("_raw")
    )
    return Normalizer(inputCol="_raw", outputCol="features", p=2.0).transform(raw).drop("_raw")


def spread_start(sample: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    """Up to ``k`` starting centres by k-means++ on a bounded sample; the first j of them start j clusters."""
    rng = np.random.default_rng(seed)
    chosen = [sample[rng.integers(len(sample))]]
    nearest = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k and nearest.max() > 0:
        chosen.append(sample[rng.choice(len(sample), p=nearest / nearest.sum())])
        nearest = np.minimum(nearest, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def _lloyd_sums(centres: dict[int, np.ndarray]):
    """One pass for every k: a task's sums, counts and costs per centre, added up over its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros_like(c) for k, c in centres.items()}
        counts = {k: np.zeros(len(c)) for k, c in centres.items()}
        costs = {k: np.zeros(len(c)) for k, c in centres.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column(0))
            squares = (rows**2).sum(axis=1)
            for k, own in centres.items():
                distance = squares[:, None] - 2.0 * (rows @ own.T) + (own**2).sum(axis=1)
                home = distance.argmin(axis=1)
                np.add.at(sums[k], home, rows)
                counts[k] += np.bincount(home, minlength=len(own))
                least = np.maximum(distance[np.arange(len(home)), home], 0.0)
                costs[k] += np.bincount(home, weights=least, minlength=len(own))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, c in centres.items() for _ in c], pa.int32()),
                pa.array([i for c in centres.values() for i in range(len(c))], pa.int32()),
                pa.array([x for found in counts.values() for x in found], pa.float64()),
                pa.array([x for found in costs.values() for x in found], pa.float64()),
                pa.array([x.tolist() for found in sums.values() for x in found], pa.list_(pa.float64())),
            ],
            names=["k", "centre", "n", "cost", "total"],
        )

    return run


def fit_all_k(
    features: DataFrame, k_range: Iterable[int] = K_RANGE, seed: int = SEED, rounds: int = ROUNDS
) -> dict[int, tuple[np.ndarray, float]]:
    """Centres and cost of k-means for every usable k, by Lloyd's steps of all of them side by side.

    Each round is one pass over the vectors; what a task returns, and the driver keeps, is one row per
    centre of every k. Starting centres come from a bounded sample (k-means++).
    """
    rows = features.select(vector_to_array("features").alias("v"))
    total = rows.count()
    ks = sorted({k for k in k_range if 1 < k < total})
    if not ks:
        return {}
    wanted = START_ROWS * ks[-1]
    mixed = F.xxhash64("v")
    keep_one_in = max(1, total // (4 * wanted))
    sample = rows.filter(F.pmod(mixed, F.lit(keep_one_in)) == 0).orderBy(mixed, "v").limit(wanted).toArrow()
    start = spread_start(matrix(sample.column(0)), ks[-1], seed)
    centres = {k: start[:k].copy() for k in ks}
    moving, cost = dict(centres), {}
    schema = "k INT, centre INT, n DOUBLE, cost DOUBLE, total ARRAY<DOUBLE>"
    for _ in range(rounds + 1):
        parts = rows.mapInArrow(_lloyd_sums(moving), schema)
        summed = parts.groupBy("k", "centre").agg(
            F.sum("n").alias("n"), F.sum("cost").alias("cost"),
            vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"),
        )
        cost.update(dict.fromkeys(moving, 0.0))
        after = {k: c.copy() for k, c in moving.items()}
        for row in sorted(summed.collect(), key=lambda r: (r["k"], r["centre"])):
            cost[row["k"]] += row["cost"]
            if row["n"]:
                after[row["k"]][row["centre"]] = np.array(row["total"]) / row["n"]
        # The cost belongs to the centres that were measured; a k stops when its centres stand still.
        still = [k for k, c in moving.items() if ((after[k] - c) ** 2).sum(axis=1).max() <= TOLERANCE]
        centres.update(moving)
        moving = {k: c for k, c in after.items() if k not in still}
        if not moving:
            break
    return {k: (centres[k], cost[k]) for k in ks}


def inertia_curve(
    features: DataFrame, k_range: Iterable[int] = K_RANGE, seed: int = SEED, rounds: int = ROUNDS
) -> list[tuple[int, float]]:
    """K-means cost for every usable k of the range."""
    return [(k, float(cost)) for k, (_, cost) in fit_all_k(features, k_range, seed, rounds).items()]


def knee(curve: list[tuple[int, float]], sensitivity: float = 1.0) -> int | None:
    """Knee of a falling convex curve (Satopaa et al., 2011), or None where it has none."""
    if len(curve) < 3:
        return None
    x, y = (np.array(side, dtype=float) for side in zip(*sorted(curve)))
    if np.ptp(y) == 0:
        return None
    xs = (x - x.min()) / np.ptp(x)
    gain = (y.max() - y) / np.ptp(y) - xs
    step = sensitivity * np.abs(np.diff(xs)).mean()
    peak, bar = None, 0.0
    for i in range(1, len(xs)):
        here = gain[i]
        if i < len(xs) - 1 and here >= gain[i - 1] and here >= gain[i + 1]:
            peak, bar = i, here - step
        elif i < len(xs) - 1 and here <= gain[i - 1] and here <= gain[i + 1]:
            bar = 0.0
        elif peak is not None and here < bar:
            break
    else:
        if peak is None or gain[-1] >= bar:
            return None
    return int(x[peak])


def curvature(curve: DataFrame) -> DataFrame:
    """Second derivative of a curve ``k, inertia`` by central differences, one-sided at the ends.

    Works on one row per tried k, so its single-partition window stays tiny.
    """
    order = W.orderBy("k")

    def gradient(df: DataFrame, value: str, name: str) -> DataFrame:
        before_x, after_x = F.lag("k").over(order), F.lead("k").over(order)
        before, after = F.lag(value).over(order), F.lead(value).over(order)
        here, x = F.col(value), F.col("k")
        left, right = (x - before_x), (after_x - x)
        inner = (
            left * left * after + (right * right - left * left) * here - right * right * before
        ) / (left * right * (left + right))
        return df.withColumn(
            name,
            F.when(before_x.isNull(), (after - here) / right)
            .when(after_x.isNull(), (here - before) / left)
            .otherwise(inner),
        )

    second = gradient(gradient(curve.select("k", "inertia"), "inertia", "slope"), "slope", "curvature")
    edge = F.lag("k").over(order).isNull() | F.lead("k").over(order).isNull()
    return second.withColumn("is_edge", edge)


def elbow_by_curvature(curve: DataFrame) -> DataFrame:
    """One row: the inner k with the largest absolute curvature (any k when there are only two)."""
    bent = curvature(curve)
    strength = F.struct(~F.col("is_edge"), F.abs("curvature"), -F.col("k"))
    return bent.agg(F.max_by("k", strength).alias("k"))


def elbow(spark: SparkSession, curve: list[tuple[int, float]]) -> int:
    """Number of clusters at the knee of a curve, else where it bends most."""
    found = knee(curve)
    if found is not None:
        return found
    return elbow_by_curvature(spark.createDataFrame(curve, "k INT, inertia DOUBLE")).head()["k"]


def choose_k(features: DataFrame, k_range: Iterable[int] = K_RANGE, seed: int = SEED) -> int:
    """Number of clusters at the elbow of the inertia curve."""
    curve = inertia_curve(features, k_range, seed)
    return elbow(features.sparkSession, curve) if curve else max(1, min(2, features.count()))


def pca_2d(features: DataFrame) -> DataFrame:
    """Two principal components of every vector as ``x, y``.

    Spark's PCA projects without centring; the mean only shifts the picture, so it is taken off.
    """
    model = PCA(k=2, inputCol="features", outputCol="_pc").fit(features)
    points = model.transform(features).select("article_id", vector_to_array("_pc").alias("_pc"))
    centre = F.broadcast(
        points.agg(F.avg(F.col("_pc")[0]).alias("_cx"), F.avg(F.col("_pc")[1]).alias("_cy"))
    )
    return points.crossJoin(centre).select(
        "article_id", (F.col("_pc")[0] - F.col("_cx")).alias("x"), (F.col("_pc")[1] - F.col("_cy")).alias("y")
    )


@dataclass(frozen=True)
class Clustering:
    """Result of clustering a corpus: chosen k, members with coordinates, and the centroids."""

    k: int
    points: DataFrame
    centroids: DataFrame
    cost: float


def cluster_corpus(
    vectors: DataFrame,
    k: int | None = None,
    k_range: Iterable[int] = K_RANGE,
    seed: int = SEED,
    id_column: str = "article_id",
) -> Clustering:
    """Unit vectors -> k at the elbow -> k-means -> coordinates.

    The centres are those of the pass that measured the curve, so no k is fitted twice.
    """
    features = materialize(unit_features(vectors, id_column))
    spark = vectors.sparkSession
    fitted = fit_all_k(features, k_range if k is None else [k], seed)
    if fitted:
        chosen = k if k is not None else elbow(spark, [(n, cost) for n, (_, cost) in fitted.items()])
        centres, cost = fitted[chosen]
    else:  # fewer vectors than clusters: each is its own
        centres = np.unique(matrix(features.select(vector_to_array("features")).limit(k or 2).toArrow().column(0)), axis=0)
        chosen, cost = len(centres), 0.0
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster_id INT, centroid ARRAY<DOUBLE>")
    rows = features.select("article_id", vector_to_array("features").alias("embedding"))
    members = assign_to_centroids(rows, table).select("article_id", "cluster_id")
    return Clustering(chosen, members.join(pca_2d(features), "article_id"), table, cost)


def centroid_vectors(members: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Mean vector of every cluster: ``key, centroid``.

    Whole vectors are summed, in the map tasks first, so a hot cluster is no burden.
    """
    vector = array_to_vector(as_double(F.col("embedding")))
    means = members.filter("embedding IS NOT NULL").groupBy(key).agg(Summarizer.mean(vector).alias("_mean"))
    return means.select(key, vector_to_array("_mean").alias("centroid"))


def centroids(members: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Mean vectors in long form, one row per cluster and dimension: ``key, dim, value``."""
    return centroid_vectors(members, key).select(key, F.posexplode("centroid").alias("dim", "value"))


def _distances(rows: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids of a block, by one matrix product."""
    return np.maximum((rows**2).sum(axis=1)[:, None] - 2.0 * (rows @ block.T) + (block**2).sum(axis=1), 0.0)


def _centroid_blocks(centroid_table: DataFrame, key: str) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and vectors of the centroids by ascending id, a bounded block at a time."""
    ordered = centroid_table.orderBy(key).select(key, "centroid")
    ids, rows = [], []
    for row in ordered.toLocalIterator():
        ids.append(row[0])
        rows.append(row[1])
        if len(ids) == CENTROID_BLOCK:
            yield ids, np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows, np.float64)


def _nearest_in(ids: list, block: np.ndarray, key_type: pa.DataType):
    """Lowers each vector's best distance by a block of centroids; ties stay with the earlier id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(ids, key_type)
        for batch in batches:
            if not batch.num_rows:
                continue
            distance = _distances(matrix(batch.column(1)), block)
            # Rounding must not decide between equal centroids: the first within it wins.
            least = distance.min(axis=1)
            place = (distance <= least[:, None] + 1e-12 * (1.0 + least[:, None])).argmax(axis=1)
            old = batch.column(3).to_numpy(zero_copy_only=False)
            better = least < old - 1e-12 * (1.0 + np.where(np.isfinite(old), old, 0.0))
            chosen = pc.if_else(pa.array(better), known.take(pa.array(place)), batch.column(2))
            kept = pa.array(np.where(better, least, old))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], chosen, kept], names=batch.schema.names)

    return run


def assign_to_centroids(
    vectors: DataFrame, centroid_table: DataFrame, key: str = "cluster_id"
) -> DataFrame:
    """Nearest given centroid of every vector: ``article_id, key, distance2``; ties to the lower id.

    Centroids travel in blocks of bounded size; a batch of vectors is scored against a block by one matrix
    product, so no (vector, centroid) rows are made.
    """
    kind = centroid_table.schema[key].dataType
    found = vectors.filter("embedding IS NOT NULL").select(
        "article_id", as_double(F.col("embedding")).alias("embedding"),
        F.lit(None).cast(kind).alias(key), F.lit(float("inf")).alias("distance2"),
    )
    for ids, block in _centroid_blocks(centroid_table, key):
        found = found.mapInArrow(_nearest_in(ids, block, to_arrow_type(kind)), found.schema)
    return found.filter(F.col(key).isNotNull()).drop("embedding")


def inertia(vectors: DataFrame, centroid_table: DataFrame, key: str = "cluster_id") -> DataFrame:
    """One row: sum of squared distances to the nearest centroid."""
    assigned = assign_to_centroids(vectors, centroid_table, key)
    return assigned.agg(F.sum("distance2").alias("inertia"))


def prefix_inertia_curve(
    vectors: DataFrame, centroid_table: DataFrame, key: str = "cluster_id"
) -> DataFrame:
    """Inertia against the first k given centroids for every k: ``k, inertia``."""
    rows = vectors.filter("embedding IS NOT NULL").select(
        as_double(F.col("embedding")).alias("embedding"), F.lit(float("inf")).alias("least")
    )
    parts, before = [], 0
    for ids, block in _centroid_blocks(centroid_table, key):
        parts.append(rows.mapInArrow(_running_least(block, before), "k INT, inertia DOUBLE"))
        rows = rows.mapInArrow(_lowered(block), rows.schema)
        before += len(ids)
    if not parts:
        return rows.sparkSession.createDataFrame([], "k INT, inertia DOUBLE")
    return reduce(DataFrame.union, parts).groupBy("k").agg(F.sum("inertia").alias("inertia"))


def _running_least(block: np.ndarray, before: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(len(block)), False
        for batch in batches:
            if batch.num_rows:
                least = batch.column(1).to_numpy(zero_copy_only=False)[:, None]
                running = np.minimum(np.minimum.accumulate(_distances(matrix(batch.column(0)), block), axis=1), least)
                total += running.sum(axis=0)
                met = True
        if met:
            ks = pa.array(np.arange(before + 1, before + 1 + len(block)), pa.int32())
            yield pa.RecordBatch.from_arrays([ks, pa.array(total)], names=["k", "inertia"])

    return run


def _lowered(block: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                least = _distances(matrix(batch.column(0)), block).min(axis=1)
                old = batch.column(1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.minimum(least, old))], names=batch.schema.names)

    return run


def assign_unclustered(
    articles: DataFrame, clusters: DataFrame, vectors: DataFrame | None = None,
    centroid_table: DataFrame | None = None,
) -> DataFrame:
    """Cluster of every article after a refresh that did not re-cluster.

    Articles added since stay without a cluster; with ``vectors`` and ``centroid_table`` those that
    have a vector are put to their nearest centroid.
    """
    known = articles.select("article_id").join(
        clusters.select("article_id", "cluster_id"), "article_id", "left"
    )
    if vectors is None or centroid_table is None:
        return known.withColumn("is_new", F.col("cluster_id").isNull())
    missing = vectors.join(clusters.select("article_id"), "article_id", "left_anti")
    nearest = assign_to_centroids(missing, centroid_table).select(
        "article_id", F.col("cluster_id").alias("_nearest")
    )
    return known.join(nearest, "article_id", "left").select(
        "article_id",
        F.coalesce("cluster_id", "_nearest").alias("cluster_id"),
        F.col("cluster_id").isNull().alias("is_new"),
    )
