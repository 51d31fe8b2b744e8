"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its ``NEAREST`` nearest reference points (pivots), in order. Two vectors are
compared if they have the same label and length and share at least half of those pivots. Pivots are ranked
by how rarely they are near anything; two lists of ``k`` that share ``t`` pivots share one among the
``k - t + 1`` rarest of each, so a vector stands in the inverted lists of those only, and the retrieval
loses no pair that shares ``t``. A pair that meets in several lists is counted in the first. Pairs with
enough shared pivots are verified by their cosine in double precision.

Copies of a vector are one row of the index. Lists are cut into tiles of bounded size, and a task gets two
tiles of one list; it returns a number of links and one connecting edge per vector, never pairs, so a list
that a third of all vectors stand in gives many tasks of one size. Pivots come from a bounded sample and
are kept apart from each other, so that a crowd of near copies does not supply them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.llm.common import stored
from tidings.llm.near_duplicates import connected

#: Least cosine of a link.
SIMILAR = 0.98
#: Pivots in a vector's description.
NEAREST = 16
#: Pivots are ``PIVOT_FACTOR * sqrt(vectors)``, at least and at most so many; the sample they are picked
#: from has four times as many vectors.
PIVOT_FACTOR, LEAST_PIVOTS, MOST_PIVOTS = 4, 64, 2048
#: Pivots of the sample that are closer to each other than this are not both taken.
APART = 0.8
#: Vectors of one tile, and rows of it that are compared at a time.
TILE_ROWS, SLICE_ROWS = 2048, 256

_FOUND = "node bigint, links bigint, root bigint"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors (none is zero) at length one; they are scaled first, so that squares neither over- nor underflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def spaced(units: np.ndarray, wanted: int, apart: float = APART) -> np.ndarray:
    """The first unit vectors that are less similar than ``apart`` to all taken before."""
    free = np.ones(len(units), bool)
    taken: list[int] = []
    for i in range(len(units)):
        if free[i] and len(taken) < wanted:
            taken.append(i)
            free &= units @ units[i] < apart
    return units[taken]


def pick_pivots(vectors: DataFrame, wanted: int) -> dict[int, np.ndarray]:
    """Up to ``wanted`` pivots for each vector length that a sample of ``4 * wanted`` vectors holds."""
    order = [F.xxhash64("node"), F.col("node")]
    sample = vectors.orderBy(*order).limit(4 * wanted).select("dim", "embedding").toArrow()
    dims = sample.column(0).to_numpy()
    picked = {}
    for dim in np.unique(dims).tolist():
        rows = sample.column(1).combine_chunks().take(pa.array(np.flatnonzero(dims == dim)))
        values = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        picked[dim] = spaced(unit(values.reshape(-1, dim)), wanted)
    return picked


def _described(pivots: Broadcast, nearest: int):
    """Adds to each vector its nearest pivots, the nearest first; ties go to the lower number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            lists: list = [None] * len(dims)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                known = pivots.value.get(dim, np.eye(1, dim))  # a length the sample lacks has one pivot
                values = batch.column(4).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                scores = -(unit(values.astype(np.float64).reshape(-1, dim)) @ known.T)
                near = np.argsort(scores, axis=1, kind="stable")[:, :nearest]
                for i, row in zip(at.tolist(), near.astype(np.int32).tolist(), strict=True):
                    lists[i] = row
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists, pa.list_(pa.int32()))],
                names=["node", "label", "dim", "n", "embedding", "pivots"],
            )

    return run


def pivot_bits(lists: np.ndarray, words: int) -> np.ndarray:
    """Sets of pivot ranks as rows of 64-bit words."""
    bits = np.zeros((len(lists), words), np.uint64)
    rows = np.arange(len(lists))
    for column in lists.T:
        bits[rows, column >> 6] |= np.uint64(1) << (column & 63).astype(np.uint64)
    return bits


def local_roots(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least id of the component of each row and column of a link matrix (rows ``a``, columns ``b``)."""
    root_a, root_b = a.copy(), b.copy()
    left_a, left_b = np.ones(len(a), bool), np.ones(len(b), bool)
    for seed in np.flatnonzero(linked.any(axis=1)).tolist():
        if not left_a[seed]:
            continue
        mine_a, mine_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        front = np.zeros(len(a), bool)
        front[seed] = True
        while front.any():
            mine_a |= front
            reached = linked[front].any(axis=0) & ~mine_b
            mine_b |= reached
            front = linked[:, reached].any(axis=1) & ~mine_a
        least = min(a[mine_a].min(), b[mine_b].min())
        root_a[mine_a], root_b[mine_b] = least, least
        left_a &= ~mine_a
        left_b &= ~mine_b
    return root_a, root_b


def _compared(similar: float, words: int):
    """Links within two tiles of one inverted list: number of links and a connecting id per vector."""

    def side(table: pa.Table, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        part = table.take(pa.array(rows))
        lists = part.column("ranks").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        values = part.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        node, n = (part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n"))
        vectors = unit(values.astype(np.float64).reshape(len(rows), -1))
        return node, n.astype(np.float64), pivot_bits(lists.reshape(len(rows), -1), words), vectors

    def candidates(bits_a: np.ndarray, bits_b: np.ndarray, need: int, own: int) -> np.ndarray:
        """Pairs that share enough pivots, and none that ranks before the list's own."""
        shared = np.zeros((len(bits_a), len(bits_b)), np.uint8)
        earlier = np.zeros(shared.shape, bool)
        for w in range(words):
            both = bits_a[:, w, None] & bits_b[None, :, w]
            shared += np.bitwise_count(both)
            if w < own >> 6:
                earlier |= both != 0
            elif w == own >> 6:
                earlier |= (both & np.uint64((1 << (own & 63)) - 1)) != 0
        return (shared >= need) & ~earlier

    def run(key: tuple, table: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64())] * 3, names=["node", "links", "root"])
        own, first, second = (k.as_py() for k in key[2:])
        tile = table.column("tile").to_numpy(zero_copy_only=False)
        rows_a, rows_b = np.flatnonzero(tile == first), np.flatnonzero(tile == second)
        if not len(rows_a) or not len(rows_b):
            return empty
        node_a, n_a, bits_a, units_a = side(table, rows_a)
        node_b, n_b, bits_b, units_b = side(table, rows_b)
        need = (len(table.column("ranks")[0]) + 1) // 2
        linked = np.zeros((len(node_a), len(node_b)), bool)
        for at in range(0, len(node_a), SLICE_ROWS):
            part = slice(at, at + SLICE_ROWS)
            found = candidates(bits_a[part], bits_b, need, own)
            if first == second:  # each pair once
                found &= np.arange(len(node_b)) > np.arange(at, at + len(found))[:, None]
            r, c = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
            if len(r):
                near = units_a[part][r] @ units_b[c].T >= similar
                linked[np.ix_(at + r, c)] = near & found[np.ix_(r, c)]
        if not linked.any():
            return empty
        if first == second:
            linked |= linked.T
        links_a, links_b = linked @ n_b, n_a @ linked
        root_a, root_b = local_roots(linked, node_a, node_b)
        sides = [(node_a, links_a, root_a)] if first == second else [(node_a, links_a, root_a), (node_b, links_b, root_b)]
        node, links, root = (np.concatenate(part) for part in zip(*sides, strict=True))
        met = links > 0
        return pa.table({"node": node[met], "links": links[met].astype(np.int64), "root": root[met]})

    return run


def classes_of(rows: DataFrame) -> DataFrame:
    """One row for each label and vector: least id, number of rows, vector."""
    same = rows.groupBy("label", "h1", "h2").agg(
        F.min("id").alias("node"), F.count("*").alias("n"), F.first("embedding").alias("embedding")
    )
    return same.withColumn("dim", F.size("embedding"))


def index_lists(seen: DataFrame, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, int]:
    """The inverted lists, cut into pairs of tiles, and the number of pivots.

    Only the number of vectors near each pivot reaches the driver, one row a pivot.
    """
    near = seen.select(F.explode("pivots").alias("p")).groupBy("p").count().collect()
    rarest = [p for _, p in sorted((count, p) for p, count in near)]
    rank = np.zeros(max(rarest, default=0) + 1, np.int32)
    rank[rarest] = np.arange(len(rarest))
    by_rank = F.array_sort(F.transform("pivots", lambda p: F.element_at(F.lit(rank.tolist()), p + 1)))
    ranked = seen.withColumn("ranks", by_rank).drop("pivots")
    half = F.floor((F.size("ranks") + 1) / 2).cast("int")
    prefix = F.slice("ranks", F.lit(1), F.size("ranks") - half + 1)
    listed = ranked.withColumn("list", F.explode(prefix))
    sizes = listed.groupBy("label", "dim", "list").agg(F.count("*").alias("m")).where("m > 1")
    tiled = listed.join(sizes, ["label", "dim", "list"])
    tiles = F.ceil(F.col("m") / tile_rows).cast("int")
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("node"), tiles).cast("int"))
    other = F.explode(F.sequence(F.lit(0), tiles - 1))
    paired = tiled.withColumn("other", other).select(
        "label", "dim", "list", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"),
        "tile", "node", "n", "embedding", "ranks",
    )
    return paired, len(rank)


def link_counts(
    classes: DataFrame, similar: float = SIMILAR, pivots: int | None = None, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """(node, links, root) of the vectors that have links, a row for each pair of tiles they were found in."""
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, int(PIVOT_FACTOR * classes.count() ** 0.5)))
    picked = classes.sparkSession.sparkContext.broadcast(pick_pivots(classes, pivots))
    plain = classes.select("node", "label", "dim", "n", "embedding")
    schema = T.StructType([*plain.schema.fields]).add("pivots", T.ArrayType(T.IntegerType()))
    seen = stored(plain.mapInArrow(_described(picked, NEAREST), schema), "described")
    lists, known = index_lists(seen, tile_rows)
    grouped = lists.groupBy("label", "dim", "list", "first", "second")
    return stored(grouped.applyInArrow(_compared(similar, known // 64 + 1), _FOUND), "links")


def near_vectors(
    vectors: DataFrame,
    similar: float = SIMILAR,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    pivots: int | None = None,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Number of links, component and verdict of every row.

    Rows are linked if they have one label and vector length, and a cosine of ``similar`` or more. Rows
    without label or id, and vectors that are null, empty, zero, or hold a null or a number that is not
    finite, have no links. Pairs are found if they share half of their nearest pivots, which nearly all
    pairs at 0.98 do (the tests measure it); no other pair is ever linked, and copies always are. Every
    row counts as a vector, also a repeated one; the different vectors of one id share its component. A
    row without an id has no component and is kept. Other columns are not read; an empty table gives an
    empty result.
    """
    raw = F.col(vector_col)
    usable = raw.isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    bad = F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = usable & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(raw, lambda x: x != 0), F.lit(False))
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.when(usable, F.col(label_col).cast("bigint")).alias("label"),
        F.when(usable, raw).alias("embedding"),
    ).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    classes = stored(classes_of(rows.where("label IS NOT NULL")), "classes")
    found = link_counts(classes, similar, pivots, tile_rows)
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).distinct()
    parts = connected(stored(edges, "edges"))
    known = (
        classes.select("label", "h1", "h2", "node", "n")
        .join(totals, "node", "left")
        .join(parts, "node", "left")
        .select(
            "label", "h1", "h2",
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component"),
        )
    )
    placed = rows.select("id", "label", "h1", "h2").join(known, ["label", "h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return placed.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
