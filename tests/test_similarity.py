import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidings.operators import cells, search, similarity


def corpus(spark, matrix, ids=None):
    ids = range(len(matrix)) if ids is None else ids
    rows = [(int(i), [float(x) for x in row]) for i, row in zip(ids, np.asarray(matrix, dtype=np.float32))]
    return spark.createDataFrame(rows, "article_id BIGINT, embedding ARRAY<FLOAT>")


def brute_neighbours(matrix, k, threshold=None, ids=None):
    matrix = np.asarray(np.asarray(matrix, dtype=np.float32), dtype=float)
    ids = list(range(len(matrix))) if ids is None else list(ids)
    lengths = np.linalg.norm(matrix, axis=1)
    found = set()
    for i, row in enumerate(matrix):
        scored = []
        for j, other in enumerate(matrix):
            if i == j:
                continue
            size = lengths[i] * lengths[j]
            same = np.array_equal(row, other) and size > 0
            cos = 1.0 if same else (float(row @ other) / size if size else 0.0)
            if threshold is None or cos > threshold:
                scored.append((-round(cos, 9), ids[j]))
        found |= {(ids[i], other) for _, other in sorted(scored)[:k]}
    return found


def clumps(seed, groups, per_group, dims, noise):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return np.concatenate([c + noise * rng.normal(size=(per_group, dims)) for c in centres])


def edges(df):
    return {(r["id"], r["other"]) for r in df.collect()}


@pytest.mark.parametrize("threshold", [0.92, 0.7, 0.2, None])
@pytest.mark.parametrize("options", [{}, {"cell_count": 6, "tile_rows": 7}, {"cell_count": 1, "tile_rows": 16}, {"cell_count": 40, "tile_rows": 500}])
def test_exact_neighbours_match_brute_force(spark, threshold, options):
    matrix = clumps(3, 5, 14, 6, 0.25)
    found = similarity.nearest_neighbours(corpus(spark, matrix), k=4, threshold=threshold, **options)
    assert edges(found) == brute_neighbours(matrix, 4, threshold)


def test_group_of_copies_is_complete(spark):
    rng = np.random.default_rng(5)
    matrix = np.concatenate([np.tile(rng.normal(size=5), (20, 1)), rng.normal(size=(25, 5)), np.zeros((2, 5))])
    matrix[30] = matrix[31] = matrix[32]
    order = rng.permutation(len(matrix))
    ids = [int(i) * 3 + 1 for i in order]
    df = corpus(spark, matrix, ids)
    for k, threshold in ((3, 0.9), (25, 0.1), (4, None)):
        found = similarity.nearest_neighbours(df, k=k, threshold=threshold, cell_count=3, tile_rows=8)
        assert edges(found) == brute_neighbours(matrix, k, threshold, ids), (k, threshold)


def test_ranks_are_dense(spark):
    matrix = clumps(9, 3, 10, 4, 0.4)
    rows = similarity.nearest_neighbours(corpus(spark, matrix), k=5).collect()
    ranks = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["rank"])):
        ranks.setdefault(r["id"], []).append((r["rank"], r["similarity"]))
    for listed in ranks.values():
        assert [rank for rank, _ in listed] == [1, 2, 3, 4, 5]
        assert all(a >= b for (_, a), (_, b) in zip(listed, listed[1:]))


def test_lsh_adds_nothing_and_finds_most(spark):
    matrix = clumps(11, 6, 20, 8, 0.15)
    df = corpus(spark, matrix)
    exact = edges(similarity.nearest_neighbours(df, k=100, threshold=0.8))
    found = edges(similarity.nearest_neighbours(df, k=100, threshold=0.8, method="lsh", tile_rows=32))
    assert found <= exact and len(found) >= 0.9 * len(exact)
    with pytest.raises(ValueError):
        similarity.nearest_neighbours(df, method="guess")


def test_cells_compare_a_small_share_of_pairs(spark):
    """Rings and planes leave only tiles that lie near each other; the rest is never scored."""
    matrix = clumps(21, 40, 30, 16, 0.12)
    rows = corpus(spark, matrix).select(F.col("article_id").alias("id"), "embedding")
    total = len(matrix)
    centres = cells.fit_centres(cells.sample_vectors(rows, total, 320), 40)
    assigned = cells.assign(rows, centres).persist()
    tiling = cells.fit_tiling(assigned, centres, total, 12)
    seeded = cells.seed(cells.place(assigned, tiling), 5, 0.92).persist()
    assert seeded.groupBy("tile").count().agg(F.max("count")).head()[0] < 40
    met = cells.visits(seeded, tiling, cells.rings(seeded, tiling))
    share = cells.compared_pairs(seeded, met) / (total * (total - 1) / 2)
    assert share < 0.1
    found = edges(similarity.nearest_neighbours(corpus(spark, matrix), k=5, threshold=0.92, cell_count=40, tile_rows=12))
    assert found == brute_neighbours(matrix, 5, 0.92)
    # A pair of tiles is one group, never two.
    assert met.filter("a >= b").count() == 0


def test_cells_of_the_test_vectors_are_used_and_exact(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(
        F.col("vec_id").alias("article_id"), "embedding"
    )
    assert cells.cell_count(vectors.count()) > 1
    found = edges(similarity.nearest_neighbours(vectors, k=3, threshold=0.35))
    rows = vectors.orderBy("article_id").toPandas()
    units = np.stack(rows["embedding"]).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    scores = units @ units.T
    np.fill_diagonal(scores, -1)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :3]
    ids = rows["article_id"].to_numpy()
    want = {(ids[i], ids[j]) for i, row in enumerate(best) for j in row if scores[i, j] > 0.35}
    assert found == want


def test_bands_save_work_and_lose_little(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").toPandas()
    units = np.stack(rows["embedding"]).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    keys = similarity.band_keys(units, similarity.BAND_BITS, similarity.BANDS, 42)
    n = len(units)
    compared = sum((np.unique(keys[:, b], return_counts=True)[1] ** 2).sum() - n for b in range(similarity.BANDS))
    assert compared < 0.1 * n * (n - 1)
    # Partners at a similarity of exactly 0.92, the hardest ones that count.
    rng = np.random.default_rng(1)
    across = rng.normal(size=units.shape)
    across -= (across * units).sum(axis=1, keepdims=True) * units
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    partners = similarity.band_keys(0.92 * units + math.sqrt(1 - 0.92**2) * across, similarity.BAND_BITS, similarity.BANDS, 42)
    assert (keys == partners).any(axis=1).mean() >= 0.9


def articles(spark, urls):
    rows = [(i, f"t{i}", u, "2024-01-01", "d.org") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "article_id BIGINT, title STRING, url STRING, date STRING, domain STRING")


def test_pairs_are_unordered_and_guarded_by_url(spark):
    matrix = [[1, 0], [1, 0.01], [1, 0.02], [0, 1], [0, 1.01]]
    urls = ["u0", "u1", "u0", "", "u4"]
    rows = similarity.near_duplicates(corpus(spark, matrix), articles(spark, urls)).collect()
    assert {(r["a_id"], r["b_id"]) for r in rows} == {(0, 1), (1, 2)}
    assert all(r["a_id"] < r["b_id"] for r in rows)
    sims = [r["similarity"] for r in rows]
    assert sims == sorted(sims, reverse=True)


def test_same_url_neighbours_use_up_ranks(spark):
    matrix = [[1, 0], [1, 0.001], [1, 0.02]]
    urls = ["u", "u", "other"]
    found = similarity.near_duplicates(corpus(spark, matrix), articles(spark, urls), k=1)
    assert {(r["a_id"], r["b_id"]) for r in found.collect()} == {(1, 2)}


def test_threshold_is_strict_in_build_and_inclusive_in_view(spark):
    cos = 0.6
    matrix = [[1, 0], [cos, math.sqrt(1 - cos * cos)]]
    pairs = similarity.near_duplicates(corpus(spark, matrix), articles(spark, ["a", "b"]), threshold=0.5)
    exact = pairs.head()["similarity"]
    none = similarity.near_duplicates(corpus(spark, matrix), articles(spark, ["a", "b"]), threshold=exact)
    assert none.count() == 0
    assert similarity.at_least_as_similar(pairs, exact).count() == 1


def test_higher_threshold_gives_subset(spark):
    matrix = clumps(2, 4, 10, 5, 0.3)
    df = corpus(spark, matrix)
    low = edges(similarity.nearest_neighbours(df, threshold=0.5))
    high = edges(similarity.nearest_neighbours(df, threshold=0.9, cell_count=4, tile_rows=8))
    assert high <= low


def brute_search(matrix, query, k):
    matrix = np.asarray(np.asarray(matrix, dtype=np.float32), dtype=float)
    cos = (matrix @ query) / np.linalg.norm(matrix, axis=1) / np.linalg.norm(query)
    order = sorted(range(len(matrix)), key=lambda i: (-round(cos[i], 9), i))
    return order[:k]


def test_search_many_shipped_and_tiled_agree(spark):
    matrix = clumps(4, 4, 15, 6, 0.5)
    queries = clumps(8, 3, 2, 6, 0.2)
    df = corpus(spark, matrix).repartition(3)
    asked = corpus(spark, queries).withColumnRenamed("article_id", "query_id")
    for options in ({}, {"max_shipped": 2, "tile_rows": 8}):
        rows = search.search_many(df, asked, k=5, **options).collect()
        for q, vector in enumerate(np.asarray(queries, dtype=np.float32).astype(float)):
            got = [r["article_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q]
            assert got == brute_search(matrix, vector, 5), options


def test_no_queries_no_hits(spark):
    df = corpus(spark, [[1, 0]])
    empty = spark.createDataFrame([], "query_id BIGINT, embedding ARRAY<FLOAT>")
    assert search.search_many(df, empty).count() == 0


def test_both_search_paths_score_alike(spark):
    """Same scores to the last digits, whether the queries are shipped or joined; queries without a vector hit nothing."""
    matrix = clumps(5, 4, 20, 6, 0.5)
    asked = [(q, [float(x) / 3 for x in row]) for q, row in enumerate(clumps(9, 3, 2, 6, 0.2))]
    asked += [(90, None), (None, [1.0] * 6), (91, [0.0] * 6)]
    queries = spark.createDataFrame(asked, "query_id BIGINT, embedding ARRAY<DOUBLE>")
    found = []
    for options in ({}, {"max_shipped": 1, "tile_rows": 16}):
        rows = search.search_many(corpus(spark, matrix).repartition(3), queries, k=4, **options).collect()
        found.append({(r["query_id"], r["rank"]): (r["article_id"], r["score"]) for r in rows})
    assert found[0].keys() == found[1].keys() and {q for q, _ in found[0]} == {*range(len(asked) - 3), 91}
    for key, (article, score) in found[0].items():
        assert found[1][key][0] == article and abs(found[1][key][1] - score) < 1e-14


def test_overfetching_search_shuffles_no_articles(spark):
    meta = spark.range(2000).select(F.col("id").alias("article_id"), F.lit("bbc.co.uk").alias("domain"))
    df = corpus(spark, [[1, 0.001 * i] for i in range(70)])
    found = search.search_sources(df, meta, [1, 0], ["bbc"], k=5, exact=False)
    assert [r["article_id"] for r in found.orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_smaller_k_is_a_prefix(spark):
    matrix = clumps(6, 3, 10, 4, 0.6)
    df = corpus(spark, matrix)
    ten = [r["article_id"] for r in search.search(df, [1, 0, 0, 0], 10).orderBy("rank").collect()]
    three = [r["article_id"] for r in search.search(df, [1, 0, 0, 0], 3).orderBy("rank").collect()]
    assert three == ten[:3]


def test_find_similar_leaves_itself_out(spark):
    df = corpus(spark, [[1, 0], [1, 0], [0, 1]])
    got = [r["article_id"] for r in search.find_similar(df, 0, 2).orderBy("rank").collect()]
    assert got == [1, 2]
    with pytest.raises(IndexError):
        search.find_similar(df, 99)


def test_filtered_search_exact_and_overfetching(spark):
    matrix = [[1, 0.001 * i] for i in range(70)]
    rows = [(i, "bbc.co.uk" if i >= 60 else "other.org") for i in range(70)]
    meta = spark.createDataFrame(rows, "article_id BIGINT, domain STRING")
    df = corpus(spark, matrix)
    exact = search.search_sources(df, meta, [1, 0], ["bbc"], k=5)
    assert [r["article_id"] for r in exact.orderBy("rank").collect()] == [60, 61, 62, 63, 64]
    loose = search.search_sources(df, meta, [1, 0], ["bbc"], k=5, exact=False)
    assert loose.count() == 0
    assert search.search_sources(df, meta, [1, 0], None, k=5).count() == 5


def test_describe_hits(spark):
    df = corpus(spark, [[1, 0], [0, 1]])
    hits = search.describe_hits(search.search(df, [1, 0], 2), articles(spark, ["u0"]))
    got = {r["article_id"]: r["url"] for r in hits.select("article_id", "url").collect()}
    assert got == {0: "u0", 1: ""}
    assert hits.filter(F.col("score") > 1.0000001).count() == 0


@pytest.mark.parametrize("few", [0, 32, 10**6])
def test_close_pairs_equal_a_full_ranking(monkeypatch, few):
    from tidings.operators import cells, kernels

    monkeypatch.setattr(kernels, "FEW_PAIRS", few)
    rng = np.random.default_rng(few % 7)
    a, b = (kernels.unit_rows(rng.normal(size=(n, 4))) for n in (60, 90))
    a_ids, b_ids = np.arange(60), np.arange(50, 140)
    scores = a @ b.T
    scores[(scores <= 0.8) | (a_ids[:, None] == b_ids[None, :])] = -np.inf
    there, back = cells._best_in(a, b, a_ids, b_ids, 3, 0.8, True)
    for found, side, ids in ((there, scores, b_ids), (back, scores.T, a_ids)):
        rows, cols = kernels.best_columns(side, ids, 3)
        assert found[0].tolist() == rows.tolist() and found[1].tolist() == cols.tolist()
        assert np.allclose(found[2], side[rows, cols], atol=1e-12)


@pytest.mark.parametrize("few", [0, 4, 10**6])
def test_pairs_below_known_neighbours_are_left_out(monkeypatch, few):
    from tidings.operators import cells, kernels

    monkeypatch.setattr(kernels, "FEW_PAIRS", few)
    rng = np.random.default_rng(1)
    a, b = (kernels.unit_rows(rng.normal(size=(n, 6))) for n in (200, 300))
    a_ids, b_ids = np.arange(200), np.arange(200, 500)
    for floor in (0.2, -np.inf):
        # Each row has three neighbours elsewhere; two rows have none yet.
        floors = tuple(np.where(np.arange(len(x)) < 2, max(floor, -1.0), rng.uniform(0.6, 0.9, len(x))) for x in (a, b))
        scores = a @ b.T
        found = cells._best_in(a, b, a_ids, b_ids, 3, floor, True, floors)
        for (own, other, score), side, ids, least in zip(found, (scores, scores.T), (b_ids, a_ids), floors, strict=True):
            want = np.where((side > floor) & (side >= least[:, None]), side, -np.inf)
            rows, cols = kernels.best_columns(want, ids, 3)
            met = set(zip(own.tolist(), other.tolist(), strict=True))
            assert met >= set(zip(rows.tolist(), cols.tolist(), strict=True))
            assert np.allclose(score, side[own, other], atol=1e-12) and np.bincount(own).max() <= 3
            if few == 10**6 and floor > 0:
                assert len(met) < (side > floor).sum() / 4
